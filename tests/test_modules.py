import pytest
from conftest import tuples

from gitgauge.operators import modules

FILE = "repo string, path string, content string, target string, rank int"
TREE = ["src/app.ts", "src/lib/index.ts", "src/lib/a.tsx", "src/lib/a.js", "src/b.ts", "pkg/__init__.py", "pkg/mod.py", "pkg/sub/deep.py", "src/tool.py",
        "src/main/java/org/x/Y.java", "data.json"]


@pytest.fixture
def graph(frame):
    def run(path, content, *more):
        rows = [("r", p, None) for p in TREE if p != path] + [("r", path, content), ("other", "src/only.ts", None), *more]
        return modules.module_graph(frame(FILE, *[(*r, "t", 1) for r in rows]))
    return run


@pytest.mark.parametrize("line,target,package", [
    ("import x from './lib'", "src/lib/index.ts", None), ("import {\n a,\n b\n} from \"./lib/a\"", "src/lib/a.tsx", None),
    ("import './lib/a.js'", "src/lib/a.js", None), ("export * from './b.js'", "src/b.ts", None), ("const d = require('../data.json')", "data.json", None),
    ("await import('@/lib/a')", "src/lib/a.tsx", None), ("import '/src/b'", "src/b.ts", None), ("import f from './gone'", None, None),
    ("import r from 'react/jsx'", None, "react"), ("import s from '@s/kit/deep'", None, "@s/kit"), ("import fs from 'node:fs/promises'", None, "fs"),
    ("import o from '../../../far'", None, None), ("import o from './only'", None, None),
])
def test_script_imports(graph, line, target, package):
    assert tuples(graph("src/app.ts", line), "source", "target", "package") == [("src/app.ts", target, package)]


@pytest.mark.parametrize("line,found", [
    ("from os import path", [("os", "path", None, "os")]), ("import numpy", [("numpy", "", None, "numpy")]),
    ("import os.path as p, pkg.mod  # both", [("os.path", "", None, "os"), ("pkg.mod", "", "pkg/mod.py", None)]),
    ("from pkg import mod, gone", [("pkg", "gone", "pkg/__init__.py", None), ("pkg", "mod", "pkg/mod.py", None)]),
    ("from pkg import (\n    mod as m,\n    x\n)", [("pkg", "mod", "pkg/mod.py", None), ("pkg", "x", "pkg/__init__.py", None)]),
    ("from tool import *", [("tool", "", "src/tool.py", None)]), ("    from ...pkg.mod import y", [("...pkg.mod", "y", "pkg/mod.py", None)]),
    ("from ....pkg import y", [("....pkg", "y", None, None)]),
    ("x = 'import y'", []), ("from . import", []),
])
def test_module_imports_from_a_script_folder(graph, line, found):
    got = tuples(graph("src/x/run.py", line + "\r\n"), "spec", "name", "target", "package")
    assert got == sorted(found, key=repr)


def test_relative_module_imports(graph):
    got = tuples(graph("pkg/sub/use.py", "from . import deep\nfrom .. import mod\nfrom ..mod import z\nfrom .deep import q\nfrom .none import q\n"), "spec", "name", "target")
    assert got == sorted([(".", "deep", "pkg/sub/deep.py"), ("..", "mod", "pkg/mod.py"), ("..mod", "z", "pkg/mod.py"), (".deep", "q", "pkg/sub/deep.py"),
                          (".none", "q", None)], key=repr)


def test_other_languages_nulls_and_repeats(graph, frame):
    java = "import static org.x.Y;\nimport java.util.List;\nimport java.util.List;"
    assert tuples(graph("a/Z.java", java, ("r", "a/Z.java", java)), "spec", "target", "package") == [
        ("java.util.List", None, "java.util"), ("org.x.Y", "src/main/java/org/x/Y.java", None)]
    assert tuples(graph("m.go", 'import (\n\tq "net/http"\n\t"example.org/a/b/c"\n)\n'), "spec", "package") == [
        ("example.org/a/b/c", "example.org/a/b"), ("net/http", "net/http")]
    assert tuples(graph("notes.md", "import x from './lib'")) == [] and tuples(graph("src/e.ts", "")) == []
    assert tuples(modules.module_graph(frame(FILE))) == []


def test_counts(graph, frame):
    got = graph("src/app.ts", "import './b'\nimport 'k'\nimport 'k/x'", ("r", "src/lib/c.ts", "import '../b'\nimport 'k'"))
    assert tuples(modules.module_packages(got)) == [("r", "k", 2)]
    assert tuples(modules.module_users(got)) == [("r", "src/b.ts", 2)]
