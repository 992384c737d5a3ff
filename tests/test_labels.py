"""The labels of the code corpus, held against its text by other means than the scanner."""

import ast
import re

import pytest

from quillscan.sources.snippets import CALLS, SNIPPETS

PYTHON = [k for k, s in enumerate(SNIPPETS) if s.ext == ".py"]


@pytest.mark.parametrize("k", PYTHON)
def test_labels_of_python_calls_are_those_of_its_own_parser(k):
    text = SNIPPETS[k].content.replace("{k}", "7")
    source = lambda node: ast.get_source_segment(text, node)
    want = set()
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.Call):
            f = node.func
            name, on = (f.attr, source(f.value)) if isinstance(f, ast.Attribute) else (f.id, None)
            given = [source(a) for a in node.args] + [f"{x.arg}={source(x.value)}" for x in node.keywords]
            want.add((node.lineno, name, on, *given))
    assert {tuple(x.replace("{k}", "7") if isinstance(x, str) else x for x in call) for call in CALLS.get(k, ())} == want


@pytest.mark.parametrize("k", [k for k in range(len(SNIPPETS)) if k not in PYTHON])
def test_labels_of_other_calls_stand_in_the_text(k):
    """Each label is written out at its line, and each name before a bracket has as many labels."""
    s = SNIPPETS[k]
    lines = s.content.split("\n")
    counted: dict = {}
    for line, name, on, *given in CALLS.get(k, ()):
        joined = r"\s*,\s*".join(map(re.escape, given))
        before = re.escape(on) + r"\s*(?:\.|->|::)\s*" if on else r"(?<![\w$.>:])(?:new\s+)?"
        assert re.search(before + re.escape(name) + r"\s*\(\s*" + joined + r"\s*\)", lines[line - 1]), (line, name)
        counted[line, name] = counted.get((line, name), 0) + 1
    words = {"function", "if", "for", "while", "switch", "catch", "return", "array"}
    for n, line in enumerate(lines, 1):
        code = re.sub(r"//.*|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`", lambda m: "_" * len(m[0]), line) if s.ext != ".rb" else ""
        defined = re.search(r"\b(?:function|func)\s+(\w+)\s*\(|^\s*(?:public |private |static )*[\w<>\[\]]+\s+(\w+)\s*\([^()]*\)\s*(?:throws\s+\w+\s*)?\{", code)
        names = [w for w in re.findall(r"([A-Za-z_]\w*)\s*\(", code) if w not in words and not (defined and w in defined.groups())]
        for w in names:
            assert names.count(w) <= counted.get((n, w), 0), (n, w)


def test_every_labelled_place_is_a_line():
    for s in SNIPPETS:
        n = len(s.content.split("\n"))
        for line in [x[1] for x in s.findings] + [y for x in s.flows for y in x[:2]] + [y for x in s.chains for y in x[:2]] + [x[2] for x in s.edges] + [y for x in s.pairs for y in x]:
            assert 1 <= line <= n
