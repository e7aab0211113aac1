"""Code chunks by structure."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestream.operators import chunking

PYTHON = '''"""Module.

def not_a_definition(:
"""
import os

@decorator(
    "x", ")def no(")
class Large:
    """Docs { ( [
    def neither():
    """

    def one(self, a=")", b="'", c=(1,
def_value)):
        return "def two(:"  # def three(:

    def two(self):
        x = """
    def inner():
"""
        return x

    async def four(self):
        def nested():
            pass
        return nested

def last():
    pass
'''


def starts(blocks):
    return [next(x for x in b.split("\n") if x.strip()).strip() for b in blocks]


def test_python_is_cut_at_definitions_only():
    blocks = chunking._code_blocks(PYTHON, 10)
    assert "\n".join(blocks) == PYTHON
    assert starts(blocks) == ['"""Module.', "@decorator(", "def one(self, a=\")\", b=\"'\", c=(1,", "def two(self):", "async def four(self):", "def nested():", "def last():"]
    assert len(chunking._code_blocks(PYTHON, 1000)) == 1


@pytest.mark.parametrize(
    ("language", "source", "cut"),
    [
        ("javascript", "import a;\nconst s = `{\nfunction no() {\n`;\nexport class A {\n  function one() { return '}' }\n  /* } function\nfunction no() {\n */\n  function two() {\n    return \"{\";\n  }\n}\nfunction b() {}\n", ["import a;", "export class A {", "function one() { return '}' }", "function two() {", "function b() {}"]),
        ("go", "package a\n\nvar s = `\nfunc no() {`\n\nfunc One() {\n\tx := \"{\"\n\t// {\n\tuse(x, x, x, x)\n}\n\nfunc Two() {\n\treturn\n}\n", ["package a", "var s = `", "func One() {", "func Two() {"]),
        ("rust", "use a;\n\nstatic S: &str = r#\"\nfn no() { \"\n\"#;\n\npub fn one<'a>(x: &'a str) -> char {\n    '{'\n}\n\nimpl T {\n    fn two(&self) -> u8 { 1 }\n}\n", ["use a;", "pub fn one<'a>(x: &'a str) -> char {", "impl T {"]),
        ("java", "package a;\n\npublic class Big {\n    String s = \"{ class No {\";\n    class Inner { int x = 1; int y = 2; }\n    record Other(int a) { }\n    interface Third { void run(int a, int b); }\n}\n\nenum Last { A }\n", ["package a;", "public class Big {", "class Inner { int x = 1; int y = 2; }", "record Other(int a) { }", "interface Third { void run(int a, int b); }", "enum Last { A }"]),
        ("cpp", "#include <a>\nauto s = R\"x(\nstruct No {\n)x\";\nstruct A {\n  int a; // struct B {\n  int b, c, d, e, f;\n};\nint run(int a) {\n  return a;\n}\n", ["#include <a>", "struct A {", "int run(int a) {"]),
        ("ruby", "require 'a'\n\nclass A\n  # def no\n  S = \"\ndef neither\n\"\n  def one\n    1\n  end\n\n  def two\n    2\n  end\nend\n\ndef last\nend\n", ["require 'a'", "class A", "def one", "def two", "def last"]),
        ("bash", "x=1\nhelp() {\n  echo \"\nfunction no() {\n\"\n}\n\nfunction run {\n  # run() {\n  echo 1\n}\n", ["x=1", "function run {"]),
    ],
)
def test_other_languages(language, source, cut):
    blocks = chunking._code_blocks(source, 5, language)
    assert "\n".join(blocks) == source
    assert starts(blocks) == cut


def test_blocks_keep_every_line():
    for language in chunking.LANGUAGES:
        for source in (PYTHON, "", "\n\n", "{{{ ((", "}}}", '"""', "'", "`", "class A {\n" * 50, "def f():\n    pass\n" * 200):
            assert "\n".join(chunking._code_blocks(source, 8, language)).strip("\n") == source.strip("\n") or not source.strip()


def test_code_strategy_on_files(spark):
    big = PYTHON + "\n".join(f"def f{i}():\n    return '{'x' * 60}'\n" for i in range(40))
    rows = spark.createDataFrame([("a.py", "code/python", big), ("b.go", None, "package a\n" * 3)], "file_path string, content_type string, text string")
    got = chunking.code(rows, size=64).orderBy("file_path", "chunk_index").collect()
    mine = [r.chunk for r in got if r.file_path == "a.py"]
    assert "\n".join(mine) == big and all(len(c) <= 2 * 64 * 4 for c in mine)
    assert chunking.code(rows.where(F.lit(False))).count() == 0
