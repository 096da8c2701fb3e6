"""Language of a path, by exact file name first and by case-sensitive extension then."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages and their file names.
FILE_NAMES = """
cmake: CMakeLists.txt
dockerfile: Dockerfile Containerfile
earthfile: Earthfile
gomod: go.mod
kconfig: Kconfig Kconfig.defconfig
make: Makefile makefile GNUmakefile
nginx: nginx.conf nginx.conf.template
"""
# Languages and their extensions.
EXTENSIONS = """
ada: ada ads adb
agda: agda lagda
asm: asm s S
bash: sh bash zsh ksh dash bashrc profile env aliases zshrc zprofile zshenv zlogin zlogout
bicep: bicep
c: c h
c-sharp: cs
clojure: clj cljs cljc edn
cmake: cmake
commonlisp: lisp cl lsp
cpp: cpp cc cxx c++ hpp hh hxx h++ ixx
css: css
cuda: cu cuh
d: d
dart: dart
dot: dot gv
elixir: ex exs
elm: elm
embedded-template: erb ejs
erlang: erl hrl
fish: fish
fortran: f f90 f95 f03 f08 for
fsharp: fs fsx fsi
gleam: gleam
glsl: glsl vert frag geom comp tesc tese rgen rchit rmiss rahit rint call
go: go
graphql: graphql gql
haskell: hs lhs
hcl: hcl tf tfvars
heex: heex
hlsl: hlsl fx fxh hlsli
html: html htm
ini: ini cfg
java: java
json: json jsonc
julia: jl
kotlin: kt kts ktm
less: less
llvm: ll
lua: lua
make: mk mak
matlab: m
nickel: ncl
nix: nix
objc: mm
ocaml: ml mli mly
ocamllex: mll
odin: odin
org: org
perl: pl pm t
php: php phtml php3 php4 php5 php7 phps
powershell: ps1 psm1 psd1 ps1xml
prisma-io: prisma
prolog: pro P
properties: properties
proto: proto
python: py pyw pyx pxd pxi
r: r R Rmd
racket: rkt scrbl rktd
ruby: rb ruby
rust: rs
scala: scala sc
scheme: scm ss
scss: scss sass
slint: slint
solidity: sol
sparql: rq sparql
swift: swift
systemverilog: sv svh
toml: toml
tsx: jsx tsx
typescript: js mjs cjs ts
verilog: v vh
vhdl: vhd vhdl
xml: xml xsd xslt svg plist rss atom xaml
yaml: yaml yml
zig: zig
"""
DOC_EXTENSIONS = {"md": "markdown", "mdx": "markdown", "txt": "text"}


def _table(text: str) -> dict[str, str]:
    return {key: language for line in text.strip().splitlines() for language, _, keys in [line.partition(": ")] for key in keys.split()}


BY_NAME, BY_EXTENSION = _table(FILE_NAMES), _table(EXTENSIONS)


def base_name(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


def extension(path: str) -> str | None:
    """What follows the last dot of the file name; None without one or where only a leading dot stands."""
    stem, dot, ext = base_name(path).rpartition(".")
    return ext if dot and stem else None


def detect(path: str | None) -> str | None:
    if not path:
        return None
    return BY_NAME.get(base_name(path)) or BY_EXTENSION.get(extension(path) or "")


def detect_doc(path: str | None) -> str | None:
    return DOC_EXTENSIONS.get(extension(path) or "") if path else None


def base_column(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def extension_column(path: Column) -> Column:
    return F.nullif(F.regexp_extract(base_column(path), r"^.+\.([^.]*)$", 1), F.lit(""))


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def language_column(path: Column) -> Column:
    """Native form of :func:`detect`; NULL for NULL and unknown paths."""
    return F.coalesce(F.element_at(_map(BY_NAME), base_column(path)), F.element_at(_map(BY_EXTENSION), extension_column(path)))


def doc_language_column(path: Column) -> Column:
    return F.element_at(_map(DOC_EXTENSIONS), extension_column(path))
