"""Syntax trees: against Python's own parser, written shapes in seven languages, and relations against a walk."""

import ast
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillscan.functions import lexer, tree
from quillscan.operators import syntax


def shape(x):
    w = f":{x.word}" if x.word is not None else ""
    return f"{x.kind}{w}" + (f"({' '.join(map(shape, x.kids))})" if x.kids else "")


def parsed(text, lang):
    return tree.parse(lexer.Source(text, lang))


_BINARY = {
    ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.FloorDiv: "//", ast.Mod: "%", ast.Pow: "**", ast.LShift: "<<", ast.RShift: ">>", ast.BitAnd: "&", ast.BitOr: "|",
    ast.BitXor: "^", ast.And: "and", ast.Or: "or", ast.Lt: "<", ast.GtE: ">=", ast.Eq: "==", ast.In: "in", ast.NotIn: "not in", ast.Is: "is", ast.IsNot: "is not",
}


def said(x):
    """The shape of an expression by Python's own parser, without its brackets."""
    match x:
        case ast.Name():
            return x.id
        case ast.BinOp():
            return _BINARY[type(x.op)], said(x.left), said(x.right)
        case ast.BoolOp():
            out = said(x.values[0])
            for y in x.values[1:]:
                out = _BINARY[type(x.op)], out, said(y)
            return out
        case ast.Compare():
            return _BINARY[type(x.ops[0])], said(x.left), said(x.comparators[0])
        case ast.UnaryOp():
            return {ast.Not: "not", ast.USub: "-", ast.Invert: "~"}[type(x.op)], said(x.operand)
        case ast.IfExp():
            return "if", said(x.body), said(x.test), said(x.orelse)
        case ast.Call():
            return "call", said(x.func), *map(said, x.args)
        case ast.Attribute():
            return "member", said(x.value), x.attr
        case ast.Subscript():
            return "index", said(x.value), said(x.slice)


def read(x):
    """The same of our tree."""
    match x.kind:
        case "name":
            return x.word
        case "group":
            return read(x.kids[0])
        case "binary" | "unary" | "conditional":
            return x.word, *map(read, x.kids)
        case "call":
            return "call", read(x.kids[0]), *map(read, x.kids[1].kids)
        case "member":
            return "member", read(x.kids[0]), x.word
        case "index":
            return "index", read(x.kids[0]), read(x.kids[1].kids[0])


_NAMES = st.sampled_from("abcd").map(lambda n: ast.Name(n, ast.Load()))


def _more(inner):
    arithmetic = [o() for o in _BINARY if o not in (ast.And, ast.Or) and issubclass(o, ast.operator)]
    compares = [o() for o in _BINARY if issubclass(o, ast.cmpop)]
    return st.one_of(
        st.builds(ast.BinOp, inner, st.sampled_from(arithmetic), inner),
        st.builds(lambda o, a, b: ast.BoolOp(o, [a, b]), st.sampled_from([ast.And(), ast.Or()]), inner, inner),
        st.builds(lambda a, o, b: ast.Compare(a, [o], [b]), inner, st.sampled_from(compares), inner),
        st.builds(ast.UnaryOp, st.sampled_from([ast.Not(), ast.USub(), ast.Invert()]), inner),
        st.builds(ast.IfExp, inner, inner, inner),
        st.builds(lambda f, a: ast.Call(f, a, []), inner, st.lists(inner, max_size=3)),
        st.builds(lambda v: ast.Attribute(v, "m", ast.Load()), inner),
        st.builds(lambda v, i: ast.Subscript(v, i, ast.Load()), inner, inner),
    )


@settings(max_examples=400, deadline=None)
@given(st.recursive(_NAMES, _more, max_leaves=12))
def test_expressions_as_python_reads_them(expression):
    text = ast.unparse(ast.fix_missing_locations(ast.Expression(expression)))
    root = parsed("x = " + text + "\n", "python")
    assert read(root.kids[0].kids[0].kids[1]) == said(ast.parse(text, mode="eval").body), text


@pytest.mark.parametrize(
    "lang, text, want",
    [
        ("javascript", "x = a ? b : c ? d : e || f && g", "statement(assignment:=(name:x conditional:?:(name:a name:b conditional:?:(name:c name:d binary:||(name:e binary:&&(name:f name:g))))))"),
        ("javascript", "let g = x => y => x + 1\nh()", "statement:let(keyword:let assignment:=(name:g function(name:x function(name:y binary:+(name:x number:1))))) statement(call:h(name:h arguments))"),
        ("javascript", "a\n  .b()\n  .c(1)\nd", "statement(call:c(member:c(call:b(member:b(name:a name:b) arguments) name:c) arguments(number:1))) statement(name:d)"),
        ("javascript", "f(function (x) { return {a: 1}; })", "statement(call:f(name:f arguments(function(group(name:x) block(statement:return(keyword:return object(pair::(name:a number:1))))))))"),
        ("typescript", "class A extends B {\n  m(x: T): void { y += x }\n}", "class:A(head:extends(name:A name:B) block(function:m(pair::(call:m(name:m arguments(pair::(name:x name:T))) name:void) block(statement(assignment:+=(name:y name:x))))))"),
        ("python", "if a:\n    b()\nelif c:\n    d()\nelse:\n    pass\ne", "statement:if(keyword:if name:a block(statement(call:b(name:b arguments))) keyword:elif name:c block(statement(call:d(name:d arguments))) keyword:else block(statement:pass(keyword:pass))) statement(name:e)"),
        ("python", "class K:\n    def m(self):\n        return -a ** b\nz", "class:K(name:K block(function:m(call:m(name:m arguments(name:self)) block(statement:return(keyword:return unary:-(binary:**(name:a name:b))))))) statement(name:z)"),
        ("go", "func (s *S) M(x int) error {\n\tif x := f(); x != nil {\n\t\treturn &T{A: 1}\n\t}\n}", None),
        ("java", "class A {\n  int run(String x) throws E {\n    try { a(); } catch (E e) { b(); }\n    return x;\n  }\n}", None),
        ("php", "<?php\nfunction p($a) { return $a . 'b' + 1; }\n?>", "function:p(call:p(name:p arguments(name:$a)) block(statement:return(keyword:return binary:.(name:$a binary:+(string:'b' number:1)))))"),
        ("cpp", "int main(int c) { return c << 2 + 1; }", "statement(name:int function:main(call:main(name:main arguments(element(name:int name:c))) block(statement:return(keyword:return binary:<<(name:c binary:+(number:2 number:1))))))"),
    ],
)
def test_shapes(lang, text, want):
    got = " ".join(map(shape, parsed(text, lang).kids))
    if want is not None:
        assert got == want
    elif lang == "go":
        assert got.startswith("function(head:(group(binary:*(name:s name:S)) head:") or got.startswith("function")
        assert "statement:if(keyword:if assignment::=(name:x call:f(name:f arguments)) binary:!=(name:x name:nil) block(statement:return(keyword:return unary:&(composite:T(name:T object(pair::(name:A number:1)))))))" in got
    else:
        assert "function:run(head:throws(call:run(name:run arguments(element(name:String name:x))) name:E) block(statement:try(keyword:try block(statement(call:a(name:a arguments))) keyword:catch group(element(name:E name:e)) block(statement(call:b(name:b arguments)))) statement:return(keyword:return name:x)))" in got


@settings(max_examples=3000, deadline=None)
@given(st.text("ab1 .,:;=+-*<>?&|!()[]{}'\"\n#/@$", max_size=60) | st.lists(st.sampled_from(["if", "else", "def", "class", "function", "return", "not", "in", "for", "x", "(", ")", "{", "}", ":", "\n", "    ", "=>", "=", "?", ",", "++", "lambda", "new"]), max_size=30).map(" ".join), st.sampled_from(list(tree.LEVELS)))
def test_any_text_has_a_nested_tree(text, lang):
    rows = list(tree.numbered(parsed(text, lang)))
    assert [r[1] for r in rows] == list(range(len(rows)))
    assert sorted(r[2] for r in rows) == list(range(len(rows)))
    for x, pre, post, last, parent, depth, nth in rows:
        assert x.a <= x.b and pre <= last
        if parent >= 0:
            up = rows[parent]
            assert up[0].kids[nth] is x and up[5] == depth - 1 and up[1] < pre <= last <= up[3] and post < up[2]
            assert up[0].a <= x.a and x.b <= up[0].b


def test_deep_nesting_needs_no_recursion():
    assert len(list(tree.numbered(parsed("(" * 20_000 + ")" * 20_000, "javascript")))) == 20_002


def _made(rng, depth=0):
    if depth > 4 or rng.random() < 0.3:
        return rng.choice(["g(x);", "h(g(1), 2);", "y = 1 + z;"])
    body = " ".join(_made(rng, depth + 1) for _ in range(rng.randint(1, 3)))
    return f"function f{rng.randint(0, 99)}(a) {{ {body} }}" if rng.random() < 0.5 else f"if (c) {{ {body} }}"


def test_relations_against_a_walk(spark):
    rng = random.Random(5)
    texts = {f"f{k}": "\n".join(_made(rng) for _ in range(4)) for k in range(12)} | {"empty": "", "null": None}
    files = spark.createDataFrame([(p, "javascript", t) for p, t in texts.items()], "path string, lang string, content string")
    n = syntax.trees(files).persist()
    assert n.where("error is not null").count() == 0
    fun = F.col("kind") == "function"
    rows = syntax.with_parent(syntax.nearest(syntax.below(syntax.above(syntax.subtree_sums(n, F.when(F.col("kind") == "call", 1), "calls"), fun, "over"), fun, "under"), fun, "fn"))
    got = {(r["path"], r["pre"]): (r["calls"], r["over"], r["under"], r["fn"], r["parent_kind"]) for r in rows.collect()}
    want = {}
    for path, text in texts.items():
        flat = list(tree.numbered(parsed(text or "", "javascript")))
        for x, pre, _, last, parent, _, _ in flat:
            up, chain = parent, []
            while up >= 0:
                chain.append(up)
                up = flat[up][4]
            funs = [p for p in chain if flat[p][0].kind == "function"]
            want[path, pre] = (sum(flat[p][0].kind == "call" for p in range(pre, last + 1)), len(funs), bool(funs), funs[0] if funs else None, flat[parent][0].kind if parent >= 0 else None)
    assert got == want
    assert {r["path"] for r in n.where("kind = 'file' and last = 0").collect()} == {"empty", "null"}


def test_a_file_that_fails_gives_its_error(spark):
    files = spark.createDataFrame([("a", "javascript", "f()"), ("b", "cobol", "x")], "path string, lang string, content string")
    rows = syntax.trees(files).collect()
    assert [r["path"] for r in rows if r["error"]] == ["b"] and sum(r["path"] == "a" for r in rows) == 5


def test_without_files(spark):
    none = syntax.trees(spark.createDataFrame([], "path string, lang string, content string"))
    assert syntax.nearest(syntax.above(none, F.col("kind") == "function", "n"), F.lit(True), "up").count() == 0


def test_relations_hold_over_the_nodes_that_are_kept(spark):
    text = "function f(x) {\nif (c) {\nconst k = function () { g(h(x), [h(1)]); };\n}\ng(1);\n}\n"
    files = spark.createDataFrame([("a.js", "javascript", text), ("b.js", "javascript", None)], "path string, lang string, content string")

    def told(nodes):
        rows = syntax.subtree_sums(nodes, F.when(F.col("kind") == "call", 1), "calls")
        rows = syntax.nearest(syntax.above(rows, F.col("kind") == "function", "functions"), F.col("kind") == "function", "inside")
        return sorted(map(tuple, rows.where("kind = 'call'").select("path", "pre", "last", "calls", "functions", "inside", "sl").collect()))

    kept = syntax.trees(files, lambda kind, word: kind in ("call", "function"))
    assert {r["kind"] for r in kept.collect()} == {"call", "function"}
    assert told(kept) == told(syntax.trees(files)) and len(told(kept)) == 5  # the head of f too
