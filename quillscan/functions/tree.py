"""Syntax trees of seven languages: one pass of operator precedence over the scanner's tokens.

Brackets and indentation open frames; in a frame, operands and operators stand on stacks until a looser operator or
an end folds them. No call nests in another, so depth is bounded by memory only, and every token gets a place: what
doesn't fit is a leaf of kind `stray`, or a node of kind `incomplete` where an operand is missing.
"""

from __future__ import annotations

from collections.abc import Iterator

from quillscan.functions.lexer import MARK, NAME, STRING, Source, Token

#: Binary operators of each language, loosest first.
_C_LIKE = ["|| ??", "&&", "|", "^", "&", "== != === !== <>", "< > <= >= instanceof in", "<< >> >>>", "+ -", "* / %", "**"]
LEVELS = {
    "javascript": _C_LIKE,
    "typescript": [*_C_LIKE[:6], "< > <= >= instanceof in as satisfies", *_C_LIKE[7:]],
    "java": _C_LIKE,
    "cpp": _C_LIKE,
    "php": ["??", "||", "&&", "|", "^", "&", "== != === !== <> <=>", "< > <= >=", ".", "<< >>", "+ -", "* / %", "instanceof", "**"],
    "python": ["or", "and", "in is < > <= >= == !=", "|", "^", "&", "<< >>", "+ -", "* / // % @", "**"],
    "go": ["||", "&&", "== != < <= > >=", "+ - | ^", "* / % << >> & &^"],
}
#: Operators that the scanner leaves in parts; those that assign; those before an operand; words before a type.
_JOINED = {"**", "<<", ">>", ">>>", "//", "-=", "*=", "/=", "%=", "|=", "&=", "^=", "<<=", ">>=", "**=", "//=", "??=", "&&=", "||=", "<=>", "&^", "<-", "@="}
_ASSIGN = {"=", ":=", "+=", ".=", "-=", "*=", "/=", "%=", "|=", "&=", "^=", "<<=", ">>=", "**=", "//=", "??=", "&&=", "||=", "@="}
_PREFIX = {"!", "-", "+", "~", "*", "**", "&", "&&", "@", "...", "++", "--", "<-", "#"}
_PREFIX_WORDS = {"new", "typeof", "await", "delete", "yield", "not", "throw", "clone", "async", "go", "defer"}
_HEADS = {"extends", "implements", "throws", "noexcept", "with"}
#: Words that begin a definition, and the kind that it has.
_DEFINES = {"function": "function", "func": "function", "def": "function", "fn": "function", "lambda": "function", "class": "class", "interface": "class", "struct": "class", "enum": "class", "trait": "class", "type": "class"}
#: Words that begin a statement, those whose statement has blocks, and those that go on with one.
_LEADS = {"return", "case", "default", "const", "let", "var", "static", "export", "import", "from", "package", "echo", "print", "raise", "assert", "del", "global", "break", "continue", "pass", "public", "private", "protected", "final", "abstract"}
_CONTROL = {"if", "else", "elif", "elseif", "for", "foreach", "while", "do", "switch", "try", "catch", "except", "finally", "match", "select", "synchronized", "with"}
_GOES_ON = {"else", "elif", "elseif", "catch", "except", "finally"}
_POWER = {"javascript", "typescript", "python", "php"}  # where two stars are one operator
_MEMBER = {".", "->", "::", "?.", "?->"}
_UNARY, _RANK = 40.0, {lang: {op: 10.0 + k for k, ops in enumerate(levels) for op in ops.split()} for lang, levels in LEVELS.items()}


class Tree:
    """A node: its kind, a word (operator, name or literal), its first and last token, and its children in text order."""

    __slots__ = ("a", "b", "kids", "kind", "word")

    def __init__(self, kind: str, word: str | None, a: int, b: int, kids: list[Tree] | None = None):
        self.kind, self.word, self.a, self.b, self.kids = kind, word, a, b, kids or []


class _Op:
    __slots__ = ("arity", "kind", "rank", "text", "token")

    def __init__(self, text: str, rank: float, arity: int, kind: str, token: int):
        self.text, self.rank, self.arity, self.kind, self.token = text, rank, arity, kind, token


class _Frame:
    """What is open between two brackets, or at one indentation."""

    def __init__(self, kind: str, at: int, indent: int = -1):
        self.kind, self.at, self.indent = kind, at, indent
        self.parts: list[Tree] = []  # ended statements or elements
        self.now: list[Tree] = []  # ended expressions of the open one
        self.vals: list[Tree] = []
        self.ops: list[_Op] = []
        self.want = True  # an operand comes next
        self.lead: str | None = None

    @property
    def states(self) -> bool:
        return self.kind in ("file", "block")

    def fold(self) -> None:
        op = self.ops.pop()
        if op.arity == 1:
            x = self.vals.pop()
            if op.kind in ("function", "class"):
                self.vals.append(Tree(op.kind, _named(x), op.token, x.b, x.kids if x.kind == op.kind else [x]))
            else:
                self.vals.append(Tree("unary", op.text, op.token, x.b, [x]))
            return
        kids = self.vals[-op.arity :]
        del self.vals[-op.arity :]
        self.vals.append(Tree(op.kind, None if op.kind == "function" else op.text, kids[0].a, kids[-1].b, kids))

    def settle(self) -> None:
        """Gives an operator that waits for an operand up."""
        while self.want and self.ops:
            op = self.ops.pop()
            if op.arity == 1:
                if self.vals and self.ops:
                    self.now.append(Tree("stray", op.text, op.token, op.token))
                    continue
                self.vals.append(Tree("stray", op.text, op.token, op.token))
            else:
                kids = self.vals[1 - op.arity :]
                del self.vals[1 - op.arity :]
                self.vals.append(Tree("incomplete", op.text, kids[0].a, max(op.token, kids[-1].b), kids))
            self.want = False

    def end_expression(self) -> None:
        self.settle()
        while self.ops:
            self.fold()
        self.now += self.vals
        self.vals, self.want = [], True

    def stray(self, text: str, a: int, b: int) -> None:
        self.end_expression()
        self.now.append(Tree("stray", text, a, b))

    def end_part(self) -> None:
        """Ends the open statement or element."""
        self.end_expression()
        if self.now:
            x = sorted(self.now, key=lambda t: t.a)
            if self.states and not (len(x) == 1 and x[0].kind in ("function", "class", "block")):
                self.parts.append(Tree("statement", self.lead, x[0].a, x[-1].b, x))
            else:
                self.parts.append(x[0] if len(x) == 1 else Tree("element", None, x[0].a, x[-1].b, x))
        self.now, self.lead = [], None

    def operand(self, x: Tree) -> None:
        if not self.want:
            self.beside(x.a)
        self.vals.append(x)
        self.want = False

    def beside(self, token: int) -> None:
        """An operand right after another: in the head of a definition both belong to it, elsewhere an expression ends."""
        if any(op.kind in ("function", "class") for op in self.ops):
            self.operator(_Op("", 2.5, 2, "head", token))
        else:
            self.end_expression()

    def operator(self, op: _Op, right: bool = False) -> None:
        if op.arity != 1 and op.kind != "function":  # an arrow takes no more than the operand before it
            while self.ops and (self.ops[-1].rank > op.rank or (self.ops[-1].rank == op.rank and not right)):
                self.fold()
        self.ops.append(op)
        self.want = True

    def calls(self) -> bool:
        """Whether the last operand is a call, maybe with what follows a head."""
        x = self.vals[-1] if self.vals else None
        while x is not None and x.kind in ("pair", "head"):
            x = x.kids[0]
        return x is not None and x.kind == "call"

    def body(self, block: Tree) -> None:
        """Gives a block to the definition or the statement before it."""
        define = next((op for op in reversed(self.ops) if op.kind in ("function", "class")), None)
        if self.lead in _CONTROL and define is None:
            self.end_expression()
            self.now.append(block)
            return
        self.settle()
        while self.ops and self.ops[-1] is not define and (define or self.ops[-1].kind in ("head", "pair")):
            self.fold()
        if not self.vals:
            self.now.append(block)
            return
        calls, x = self.calls(), self.vals.pop()
        kind = define.kind if define else "function" if calls else "composite"
        self.vals.append(Tree(kind, _named(x), x.a, block.b, [x, block]))
        self.want = False


def _named(x: Tree) -> str | None:
    """The name that a head defines: of its first call, else its first name."""
    first = None
    stack = [x]
    while stack:
        y = stack.pop()
        if y.kind in ("call", "function", "class"):
            return y.word
        if y.kind == "name" and first is None:
            first = y.word
        if y.kind in ("head", "pair", "binary", "unary"):
            stack += reversed(y.kids)
    return first


def _called(x: Tree) -> str | None:
    return x.word if x.kind in ("name", "member", "keyword") else None


def parse(src: Source) -> Tree:
    """The tree of a file; its root has kind `file`."""
    t, lang, text = src.toks, src.lang, src.text
    rank, python, lined = _RANK[lang], lang == "python", lang in ("python", "go", "javascript", "typescript")
    frames = [_Frame("file", 0, 0)]
    k, n = 0, len(t)
    while k < n:
        f, x = frames[-1], t[k]
        new_line = k > 0 and "\n" in text[t[k - 1].end : x.start]
        if new_line and f.states and lined and not python and not f.want and _ends(t, k, lang):
            f.end_part()
        if new_line and python and f.states:
            at = src.place(x.start)[1]
            if t[k - 1].text == ":" and at > f.indent:  # a head's colon, and deeper lines
                if f.want and f.ops and f.ops[-1].text == ":":
                    f.ops.pop()
                    f.want = False
                frames.append(f := _Frame("block", k, at))
            elif not (f.want and f.ops) or at < f.indent:
                f.end_part()
                while f.indent > at and len(frames) > 1 and frames[-2].states:
                    f = _dedent(frames, k, t)
        if x.kind == STRING:
            f.operand(Tree("template" if x.dynamic else "string", x.text, k, k))
        elif x.kind == NAME:
            _word(f, t, k, lang, rank)
        elif x.text in ("(", "[", "{") and x.match > k:
            frames.append(_opened(f, t, k, lang))
        elif x.text in (")", "]", "}") and 0 <= x.match < k:
            f.end_part()
            while len(frames) > 2 and f.kind == "block" and f.indent >= 0:
                f = _dedent(frames, k, t)
                f.end_part()
            _closed(frames, t, k)
        elif x.text in ("(", "[", "{", ")", "]", "}"):
            f.stray(x.text, k, k)
        else:
            k = _mark(f, t, k, lang, rank)
        k += 1
    while len(frames) > 1:
        frames[-1].end_part()
        _closed(frames, t, n - 1) if frames[-1].indent < 0 else _dedent(frames, n, t)
    frames[0].end_part()
    return Tree("file", None, 0, max(n - 1, 0), frames[0].parts)


def _ends(t: list[Token], k: int, lang: str) -> bool:
    """Whether a line's end before token k ends a statement."""
    x = t[k]
    if lang == "go":
        return x.text != "."
    return x.kind != MARK and x.text not in ("instanceof", "in", "as", "of", "extends", "implements") or x.text in ("}", "++", "--", "!", "@", "#", "...")


def _dedent(frames: list[_Frame], k: int, t: list[Token]) -> _Frame:
    done = frames.pop()
    f = frames[-1]
    f.body(Tree("block", None, done.at, max(k - 1, done.at), done.parts))
    if k >= len(t) or t[k].text not in _GOES_ON:
        f.end_part()
    return f


def _opened(f: _Frame, t: list[Token], k: int, lang: str) -> _Frame:
    """The frame of a bracket: what it is follows from what stands before it."""
    x, before = t[k].text, t[k - 1].text if k else ""
    if x != "{":
        tail = not f.want and not (f.vals and f.vals[-1].kind in ("function", "block") and f.states and not f.ops)
        return _Frame({"(": "arguments", "[": "index"}[x] if tail else {"(": "group", "[": "list"}[x], k)
    define = any(op.kind in ("function", "class") for op in f.ops)
    if f.want:
        starts = f.states and not (f.now or f.vals or f.ops)
        return _Frame("block" if starts or before in ("=>", "->") or before in _CONTROL or define else "object", k)
    head = bool(f.ops) and all(op.kind in ("head", "pair") for op in f.ops) and f.vals[0].kind == "call"
    return _Frame("block" if define or head or f.lead in _CONTROL or f.calls() or lang in ("java", "cpp") and f.states and not f.ops else "object", k)


def _closed(frames: list[_Frame], t: list[Token], k: int) -> None:
    done = frames.pop()
    f = frames[-1]
    node = Tree(done.kind, None, done.at, k, done.parts)
    if done.kind in ("arguments", "index"):
        x = f.vals.pop()
        f.vals.append(Tree("call" if done.kind == "arguments" else "index", _called(x), x.a, k, [x, node]))
    elif done.kind in ("group", "list") or (f.want and not (f.lead in _CONTROL and done.kind == "block") and (f.ops or f.now or done.kind == "object")):
        f.operand(node)
    else:
        f.body(node)
    if done.kind != "block" or not f.states:
        return
    after = t[k + 1] if k + 1 < len(t) else None
    loops = f.lead == "do" and after is not None and after.text == "while"
    if not (after and (after.text in _GOES_ON or after.text in (",", ")", "]", ".", "(", ";", "?.") or loops)):
        f.end_part()


def _word(f: _Frame, t: list[Token], k: int, lang: str, rank: dict[str, float]) -> None:
    w = t[k].text
    named = k + 1 < len(t) and t[k + 1].text in (":", "=", ".", ",", ")", ";") or k > 0 and t[k - 1].text in _MEMBER and not (lang == "php" and t[k - 1].text == ".")
    if w[:1].isdigit():
        f.operand(Tree("number", w, k, k))
    elif not f.want and w in rank:
        f.operator(_Op(w, rank[w], 2, "binary", k))
    elif not f.want and lang == "python" and w == "else" and any(o.text == "if" and o.arity == 2 for o in f.ops):
        while f.ops[-1].text != "if" or f.ops[-1].arity != 2:
            f.fold()
        f.ops[-1].arity, f.want = 3, True
    elif not f.want and lang == "python" and w in ("if", "for"):
        f.operator(_Op(w, 6.0 if w == "if" else 1.0, 2, "conditional" if w == "if" else "comprehension", k), right=True)
    elif not f.want and w == "not" and lang == "python":
        f.operator(_Op("not", rank["in"], 2, "binary", k))
    elif w in ("in", "is") and f.want and f.ops and f.ops[-1].text == "not" and f.ops[-1].arity == 2:
        f.ops[-1].text = "not " + w
    elif w == "not" and f.want and f.ops and f.ops[-1].text == "is":
        f.ops[-1].text = "is not"
    elif not f.want and w in _HEADS and w != "with":
        f.operator(_Op(w, 2.7, 2, "head", k))
    elif w in _DEFINES and not named and not (w == "type" and lang not in ("go", "typescript")) and not (w == "def" and lang != "python"):
        if w not in ("struct", "interface", "class", "enum") or f.want:
            if not f.want:
                f.end_expression()
            f.operator(_Op(w, 2.0, 1, _DEFINES[w], k))
        else:
            f.operand(Tree("keyword", w, k, k))
    elif f.want and w in _PREFIX_WORDS and not named and (w != "not" or lang == "python") and w != "with":
        f.operator(_Op(w, rank["and"] + 0.5 if w == "not" else 2.0 if w in ("yield", "throw") else _UNARY, 1, "unary", k))
    elif (w in _CONTROL or w in _LEADS) and not (named and w not in ("else", "try", "finally", "default")) and not (w in ("with", "match", "print", "from", "type") and not (f.states and not f.now and not f.vals)):
        if not f.want or f.vals or f.ops:
            f.end_expression()
        f.now.append(Tree("keyword", w, k, k))
        f.lead = w if f.lead is None or w in _CONTROL and f.lead not in _CONTROL else f.lead
    else:
        f.operand(Tree("name", w, k, k))


def _mark(f: _Frame, t: list[Token], k: int, lang: str, rank: dict[str, float]) -> int:
    """Reads an operator or separator at token k; the last token that it took."""
    first, op = k, t[k].text
    while k + 1 < len(t) and t[k + 1].kind == MARK and t[k + 1].start == t[k].end and op + t[k + 1].text in _JOINED and (op + t[k + 1].text not in ("//", "**") or lang in _POWER):
        k += 1
        op += t[k].text
    if lang == "python" and op in ("++", "--"):  # two signs
        for sign in op:
            f.operator(_Op(sign, _UNARY if f.want else rank[sign], 1 if f.want else 2, "unary" if f.want else "binary", first))
        return k
    if lang == "php" and op in ("<", "?") and k + 1 < len(t) and t[k + 1].text == ("?" if op == "<" else ">") and t[k + 1].start == t[k].end:  # a tag
        f.end_part()
        return k + (2 if op == "<" and k + 2 < len(t) and t[k + 2].text in ("php", "=") else 1)
    arrow = op == "=>" or op == "->" and lang == "java"
    if op == ";" and not (lang == "go" and f.lead in ("if", "for", "switch") and f.states):
        f.end_part()
    elif op in (",", ";"):
        f.end_expression() if f.states else f.end_part()
    elif op in _MEMBER and not (op == "." and lang == "php") and not arrow and not (op == "->" and lang == "python"):
        if f.want or not f.vals:
            return k  # a leading dot
        if k + 1 < len(t) and t[k + 1].kind == NAME:
            x, name = f.vals.pop(), t[k + 1].text
            f.vals.append(Tree("member", name, x.a, k + 1, [x, Tree("name", name, k + 1, k + 1)]))
            return k + 1
    elif op in ("++", "--") and not f.want:
        x = f.vals.pop()
        f.vals.append(Tree("unary", op, x.a, k, [x]))
    elif f.want and op == ":" and f.ops and f.ops[-1].text == "?":
        f.ops[-1].text, f.ops[-1].kind = "?:", "binary"
    elif f.want and op in _PREFIX:
        f.operator(_Op(op, _UNARY, 1, "unary", first))
    elif f.want and op == ":" and f.now:
        return k  # the end of a label or of a head without an operand; a block may follow
    elif f.want:
        f.stray(op, first, k)
    elif op == ":" and any(o.text == "?" and o.arity == 2 for o in f.ops):
        while f.ops[-1].text != "?" or f.ops[-1].arity != 2:
            f.fold()
        f.ops[-1].text, f.ops[-1].arity, f.want = "?:", 3, True
    elif op == "?":
        f.operator(_Op("?", 6.0, 2, "conditional", first), right=True)
    elif op == ":":
        f.operator(_Op(":", 0.5 if f.kind == "object" else 2.2 if any(o.kind == "function" for o in f.ops) else 5.0 if f.states or f.kind != "index" else 3.5, 2, "pair", first))
    elif arrow:
        f.operator(_Op(op, 3.0, 2, "pair" if lang == "php" else "function", first), right=True)
    elif op in _ASSIGN:
        f.operator(_Op(op, 4.0, 2, "assignment", first), right=True)
    elif op in rank:
        f.operator(_Op(op, _UNARY + 1 if op == "**" else rank[op], 2, "binary", first), right=op == "**")
    elif op == "->":
        f.operator(_Op(op, 2.8, 2, "head", first))
    elif op == "<-":
        f.operator(_Op(op, 4.0, 2, "binary", first))
    else:
        f.stray(op, first, k)
    return k


def numbered(root: Tree) -> Iterator[tuple[Tree, int, int, int, int, int, int]]:
    """Each node in pre-order with its pre- and post-order number, the last number below it, its parent's, its depth and its place among its siblings."""
    pre, post = 0, 0
    out: list[list] = []
    walk: list[tuple[int, Tree, int]] = []  # number, node, next child
    node, parent, nth = root, -1, 0
    while True:
        out.append([node, pre, -1, pre, parent, len(walk), nth])
        walk.append((pre, node, 0))
        pre += 1
        while walk:
            number, node, child = walk.pop()
            if child < len(node.kids):
                walk.append((number, node, child + 1))
                node, parent, nth = node.kids[child], number, child
                break
            out[number][2], out[number][3] = post, pre - 1
            post += 1
        else:
            return iter(map(tuple, out))
