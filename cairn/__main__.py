"""python -m cairn"""

import sys

from cairn.api import main

sys.exit(main())
