"""The built-in rules: one boolean column each over syntax nodes, all evaluated in one pass without a join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.operators import text_rules as X

c = F.col
JS, ALL = ["javascript", "typescript"], ["javascript", "typescript", "python", "go", "java", "php"]


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    severity: str
    cwe: int
    confidence: Column | float
    category: str
    languages: tuple[str, ...]
    test: Column


def words_of(receiver: Column) -> tuple[Column, Column]:
    """Lower-case segments of a receiver path, and the words within them."""
    parts = F.transform(F.split(receiver, r"\.|->|::"), lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\(.*$", ""), r"\[[^\]]*\]", ""), r"^\$", "")))
    words = F.flatten(F.transform(parts, lambda s: F.split(s, r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")))
    low = lambda a: F.filter(F.transform(a, F.lower), lambda w: w != "")
    return low(parts), low(words)


def names_any(receiver: Column, names: list[str], suffixes: list[str] | None = None) -> Column:
    """Whether a receiver names one of `names` as a segment or word, or has a word that ends with, and isn't, a suffix.

    Segments and words are pieces of the receiver, but where an index is cut out of one: a receiver that has none of the
    names anywhere, and no index, isn't taken apart.
    """
    parts, words = words_of(receiver)
    wanted = F.lit([n.lower() for n in names])
    got = F.arrays_overlap(parts, wanted) | F.arrays_overlap(words, wanted)
    for end in suffixes or []:
        got = got | F.exists(words, lambda w: w.endswith(end) & (F.length(w) > F.lit(len(end))))  # noqa: B023
    some = X.any_in(F.lower(receiver), [n.lower() for n in names] + list(suffixes or [])) | receiver.contains("[")
    return F.coalesce(F.when(some, got), F.lit(False))


def lang(*names: str) -> Column:
    return c("lang").isin(*names)


def by_lang(default: Column, **other: Column) -> Column:
    out = F.when(F.lit(False), default)
    for name, test in other.items():
        out = out.when(c("lang") == name, test)
    return out.otherwise(default)


#: Where input of users comes from, by language.
USER = {
    "js": r"\b(req\.|params\.|query\.|body\.|request\.|args\.|argv\[|process\.argv)",
    "go": r"\b(r\.URL\.Query|r\.FormValue|r\.PostFormValue|mux\.Vars|c\.Param|c\.Query|os\.Args)\b",
    "java": r"\b(getParameter|getHeader|getQueryString)\b",
    "php": r"\$_(GET|POST|REQUEST|COOKIE)\b",
}
#: Callees, receivers and patterns of the rules.
SQL_CALLS = ["query", "execute", "raw", "exec", "prepare"]
SQL_CALLS_GO = ["Query", "QueryRow", "QueryContext", "QueryRowContext", "Exec", "ExecContext", "Prepare", "PrepareContext"]
SQL_CALLS_JAVA = ["executeQuery", "executeUpdate", "execute", "prepareStatement", "prepareCall", "createQuery", "createNativeQuery", "queryForObject", "queryForList", "update"]
SQL_ON = ["db", "database", "connection", "conn", "pool", "client", "knex", "sequelize", "prisma"]
SQL_ON_GO = ["db", "database", "conn", "pool", "tx", "stmt"]
SQL_ON_JAVA = ["stmt", "statement", "conn", "connection", "db", "jdbc", "em", "entitymanager", "session", "template"]
SQL_BARE_PHP = ["mysqli_query", "mysqli_real_query", "mysqli_multi_query", "pg_query", "sqlite_query"]
SQL_CALLS_PHP = ["query", "exec", "prepare", "real_query", "multi_query"]
SQL_ON_PHP = ["db", "database", "conn", "connection", "pdo", "mysqli", "link"]
SQL_WORD = r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|UNION|WHERE|FROM|JOIN)\b"
SHELL_JS, SHELL_ON_JS = ["exec", "execSync", "spawn", "spawnSync", "execFile", "execFileSync"], ["child_process", "cp", "childProcess"]
SHELL_PY, SHELL_ON_PY = ["system", "popen", "call", "run", "check_output", "check_call", "Popen"], ["os", "subprocess"]
SHELL_PHP = ["system", "popen", "shell_exec", "passthru", "proc_open"]
MONGO = ["find", "findOne", "findOneAndUpdate", "findOneAndDelete", "findOneAndReplace", "updateOne", "updateMany", "deleteOne", "deleteMany", "replaceOne", "aggregate"]
MONGO_TWO = ["updateOne", "updateMany", "findOneAndUpdate", "replaceOne", "findOneAndReplace"]
MONGO_PY = ["find", "find_one", "find_one_and_update", "find_one_and_delete", "find_one_and_replace", "update_one", "update_many", "delete_one", "delete_many", "replace_one", "aggregate", "count_documents"]
MONGO_TWO_PY = ["update_one", "update_many", "find_one_and_update", "replace_one", "find_one_and_replace"]
WEAK = ["md5", "sha1", "sha-1", "des", "rc4", "md4"]
CIPHERS = ["createcipheriv", "createdecipheriv", "createcipher", "createdecipher", "getinstance", "new", "openssl_encrypt", "openssl_decrypt", "mcrypt_encrypt", "mcrypt_decrypt"]
RANDOM_GO = ["Intn", "Int31", "Int31n", "Int63", "Int63n", "Float32", "Float64", "Perm", "Shuffle"]
RANDOM_PY = ["random", "randint", "randrange", "choice", "sample", "uniform"]
PATH_JS = ["readFile", "readFileSync", "writeFile", "writeFileSync", "createReadStream", "createWriteStream", "access", "accessSync", "open", "openSync", "unlink", "unlinkSync", "readdir", "readdirSync", "stat", "statSync"]
PATH_PY = ["open", "read", "write", "listdir", "remove", "unlink", "makedirs", "rmdir"]
PATH_GO = ["Open", "OpenFile", "Create", "ReadFile", "WriteFile", "Remove", "RemoveAll", "ReadDir", "Mkdir", "MkdirAll"]
PATH_NEW_JAVA = ["File", "FileInputStream", "FileOutputStream", "FileReader", "FileWriter", "RandomAccessFile"]
PATH_JAVA = ["readAllBytes", "readAllLines", "readString", "write", "writeString", "newInputStream", "newOutputStream", "newBufferedReader", "newBufferedWriter", "delete", "deleteIfExists", "createDirectories", "get", "of"]
PATH_ON_JAVA = ["Files", "Paths", "Path"]
PATH_PHP = ["file_get_contents", "file_put_contents", "fopen", "readfile", "unlink", "copy", "rename", "mkdir", "rmdir", "is_file", "file_exists"]
FILE_JS = ["readFile", "readFileSync", "writeFile", "writeFileSync", "open", "appendFile", "appendFileSync", "unlink", "unlinkSync"]
FILE_GO = ["Open", "OpenFile", "Create", "ReadFile", "WriteFile"]
FILE_JAVA = ["readAllBytes", "write", "newInputStream", "newOutputStream"]
FILE_PHP = ["file_get_contents", "file_put_contents", "fopen", "readfile"]
LOG_JS, LOG_ON_JS = ["log", "info", "warn", "error", "debug", "trace", "console.log", "print", "logging"], ["console", "logger", "log", "logging"]
LOG_GO, LOG_ON_GO = ["println", "printf", "print", "info", "infof", "error", "errorf", "warn", "warnf", "debug", "debugf", "fatal", "fatalf"], ["log", "logger", "logrus", "zap", "zerolog"]
LOG_JAVA, LOG_ON_JAVA = ["println", "print", "info", "debug", "warn", "error", "trace", "fatal"], ["logger", "log", "system.out", "system.err"]
LOG_PHP, LOG_ON_PHP, LOG_BARE_PHP = ["info", "debug", "warn", "warning", "error", "critical", "emergency", "alert", "notice", "log"], ["log", "logger"], ["error_log", "syslog"]
PERSONAL = r"(?i)\b(ssn|social.?security|credit.?card|card.?number|cvv|expir|bank.?account)\b"
SECRET_WORD = r"(?i)\b(password|token|secret|api.?key|credentials?)\b"
HTTP_BARE, HTTP_MODULES, HTTP_WHOLE = ["fetch", "axios", "request", "urlopen", "curl_init"], ["axios", "fetch", "http", "https", "got", "urllib", "requests", "httpx"], ["request", "requests"]
HTTP_VERBS = ["get", "post", "put", "delete", "patch", "head", "options", "request", "fetch", "send", "open", "urlopen", "urlretrieve", "stream", "Get", "Post", "Head", "PostForm", "Do"]
HTTP_NEW_JAVA, HTTP_JAVA = ["URL", "HttpGet", "HttpPost", "HttpPut", "HttpDelete", "HttpPatch"], ["getForObject", "getForEntity", "postForObject", "postForEntity", "exchange"]



class _Node:
    """Columns of a node, made when asked for: none can be made before a session runs."""

    name = property(lambda self: c("name"))
    object = property(lambda self: c("object"))
    text = property(lambda self: c("text"))
    args = property(lambda self: c("args_text"))
    call = property(lambda self: c("kind") == "function_call")
    bare = property(lambda self: c("object").isNull())
    any_child = property(lambda self: F.exists("children", lambda x: x["kind"].isin("template_string", "string_concat")))
    built = property(lambda self: (lang("go") & self.text.rlike(r"\bfmt\.Sprintf\s*\(")) | (lang("java") & self.text.rlike(r"\bString\.format\s*\(")))
    dynamic = property(lambda self: self.any_child | self.built)

    def on(self, names: list[str]) -> Column:
        return F.coalesce(self.object.isin(*names), F.lit(False))

    def arg(self, k: int) -> Column:
        return F.get("args", F.lit(k))


N = _Node()


def _user(x: Column) -> Column:
    return by_lang(x.rlike(USER["js"]), go=x.rlike(USER["go"]), java=x.rlike(USER["java"]), php=x.rlike(USER["php"]))


def assigned_from(what: str, test) -> Column:
    """Whether the first assignment within three lines to a call's receiver (from_object) or first argument (from_arg) has a right-hand side that passes the test."""
    return F.coalesce(test(c(what)), F.lit(False))


def near(hint: str) -> Column:
    """Whether one of parse.HINTS stands in the lines within three."""
    return F.coalesce(F.array_contains(c("near"), hint), F.lit(False))


def _sql() -> Column:
    php = (N.bare & N.name.isin(SQL_BARE_PHP) | N.name.isin(SQL_CALLS_PHP) & names_any(N.object, SQL_ON_PHP, ["db"])) & N.any_child
    meant = lambda names, on: N.name.isin(names) & (N.bare | names_any(N.object, on, ["db"]))
    py_built = X.strip_literals(N.text).rlike(r"￿\s*(?:\.\s*format\s*\(|%)") & N.text.rlike(SQL_WORD)
    script = lambda on, more: meant(SQL_CALLS, on) & (N.any_child | more) & ~N.text.rlike(r",\s*\[")
    typed = lambda names, on: meant(names, on) & N.dynamic & N.text.rlike(SQL_WORD)
    builder = ((lang("go") & (N.name == "Sprintf") & N.on(["fmt"])) | (lang("java") & (N.name == "format") & N.on(["String"]))) & N.text.rlike(SQL_WORD)
    return builder | by_lang(script(SQL_ON, F.lit(False)), python=script([*SQL_ON, "cursor"], py_built), go=typed(SQL_CALLS_GO, SQL_ON_GO), java=typed(SQL_CALLS_JAVA, SQL_ON_JAVA), php=php)


def _shell() -> Column:
    js = ~lang("java") & N.name.isin(SHELL_JS) & (N.bare | names_any(N.object, SHELL_ON_JS))
    py = lang("python") & N.name.isin(SHELL_PY) & (N.bare | names_any(N.object, SHELL_ON_PY))
    go = lang("go") & N.name.isin("Command", "CommandContext") & names_any(N.object, ["exec"])
    java = lang("java") & ((N.name == "exec") & names_any(N.object, ["runtime"]) | (N.name == "ProcessBuilder"))
    return N.dynamic & (js | py | go | java | lang("php") & N.bare & N.name.isin(SHELL_PHP))


def _where_value() -> Column:
    """A dynamic child that starts exactly where the value of $where does."""
    head = F.regexp_extract(N.text, r"(?s)^(.*?\$where['\"]?\s*(?:=>|:)?\s*)", 1)
    return (head != "") & F.exists("children", lambda x: x["kind"].isin("template_string", "string_concat") & (F.substring(N.text, F.length(head) + 1, F.length(x["text"])) == x["text"]))


def _mongo() -> Column:
    whole = lambda p, two: F.coalesce(N.arg(0).rlike(p), F.lit(False)) | (N.name.isin(two) & F.coalesce(N.arg(1).rlike(p), F.lit(False)))
    return ~N.bare & by_lang(
        N.name.isin(MONGO) & (_where_value() | whole(r"^(req|request)\.(body|query|params)$", MONGO_TWO)),
        python=N.name.isin(MONGO_PY) & (_where_value() | whole(r"^request\.(json|args|form|GET|POST|data)$", MONGO_TWO_PY)),
        php=N.name.isin(MONGO) & (_where_value() | whole(r"^\$_(GET|POST|REQUEST)$", MONGO_TWO)),
    )


def _eval() -> Column:
    first = F.coalesce(F.trim(N.arg(0)), F.lit(""))
    code = first.rlike("^['\"`]") | (~first.rlike(r"^(?:async\b|function\b|\()") & ~first.contains("=>") & first.contains("+") & first.rlike("['\"`]"))
    timer = N.name.isin("setTimeout", "setInterval") & (N.bare | N.on(["window", "globalThis", "self", "global"])) & code
    return N.name.isin("eval", "Function") | timer | (lang("python") & N.bare & (N.name == "exec"))


def _page() -> Column:
    literal = (N.args == "") | N.args.rlike("^['\"][^'\"]*['\"]\\z")
    py = N.call & N.bare & N.name.isin("mark_safe", "Markup", "render_template_string") & ~literal
    writer = F.coalesce(N.object.contains("getWriter") | assigned_from("from_object", lambda x: x.rlike(r"\bgetWriter\(\)")), F.lit(False))
    return by_lang(X.any_in(N.text, X.SINKS), python=py, java=N.call & ~N.bare & N.name.isin("write", "print", "println") & writer & ~literal)


def _crypto() -> Column:
    low = F.lower(N.text)
    weak = X.any_in(low, [q + w + q for w in WEAK for q in "'\""])
    made = N.name.isin("createHash", "createCipher", "createCipheriv", "createDecipher") | (F.coalesce(N.object.contains("hashlib"), F.lit(False)) & N.name.isin("md5", "sha1", "new"))
    own = by_lang(made & weak, go=N.on(["md5", "sha1", "des", "rc4", "md4"]), java=N.on(["MessageDigest", "Cipher"]) & (N.name == "getInstance") & weak, php=N.bare & (N.name.isin("md5", "sha1") | (N.name == "hash") & weak))
    ecb = F.lower(N.name).isin(CIPHERS) & N.text.rlike(r"(?i)(?:MODE_ECB|[/-]ecb)\b")
    return own | ecb | N.name.isin("createCipher", "createDecipher") | (lang("python") & (N.name == "new") & N.on(["DES", "ARC4", "Blowfish"]))


def _paths() -> Column:
    op = by_lang(
        N.name.isin(PATH_JS), python=N.name.isin(PATH_PY), go=N.name.isin(PATH_GO) & N.on(["os", "ioutil"]), php=N.bare & N.name.isin(PATH_PHP),
        java=N.bare & N.name.isin(PATH_NEW_JAVA) | N.on(PATH_ON_JAVA) & N.name.isin(PATH_JAVA),
    )
    safe = near("resolve") & near("starts") | lang("go") & near("clean") & near("prefix") | lang("java") & near("normal") & near("starts")
    return op & N.dynamic & ~safe


def _files() -> Column:
    op = by_lang(
        N.name.isin(FILE_JS), go=N.name.isin(FILE_GO) & N.on(["os", "ioutil"]), php=N.bare & N.name.isin(FILE_PHP),
        java=N.bare & N.name.isin(PATH_NEW_JAVA[:5]) | N.on(PATH_ON_JAVA) & N.name.isin(FILE_JAVA),
    )
    return op & (_user(N.text) | assigned_from("from_arg", _user))


def _logs() -> Column:
    on = lambda names: F.coalesce(X.any_in(F.lower(N.object), names), F.lit(False))
    low = F.lower(N.name)
    op = by_lang(
        N.name.isin(LOG_JS) | F.coalesce(F.lower(N.object).isin(LOG_ON_JS), F.lit(False)), go=on(LOG_ON_GO) & low.isin(LOG_GO),
        java=on(LOG_ON_JAVA) & low.isin(LOG_JAVA), php=low.isin(LOG_BARE_PHP) | on(LOG_ON_PHP) & low.isin(LOG_PHP),
    )
    return op & (N.text.rlike(PERSONAL) | N.text.rlike(SECRET_WORD))


def _load() -> Column:
    js = N.name.isin("deserialize", "unserialize") & ~(lang("php") & ~N.bare)
    py = lang("python") & N.name.isin("loads", "load") & N.on(["pickle", "yaml", "marshal", "dill", "cloudpickle"])
    safe = N.on(["yaml"]) & (N.name == "load") & (N.text.contains("SafeLoader") | N.text.contains("safe_load"))
    return lang("java") & (N.name == "readObject") | js | py & ~safe


def _fetch() -> Column:
    module = N.on(HTTP_WHOLE) | F.coalesce(F.exists(F.split(N.object, r"\."), lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"\[.*$", ""), r"\?$", "")).isin(HTTP_MODULES)), F.lit(False))
    script = F.when(N.bare, N.name.isin(HTTP_BARE)).otherwise(N.name.isin(HTTP_VERBS) & module)
    op = by_lang(script, java=N.bare & N.name.isin(HTTP_NEW_JAVA) | N.name.isin(HTTP_JAVA) | N.on(["URI"]) & (N.name == "create"))
    return op & (N.dynamic | _user(F.coalesce(N.args, N.text)))


def _xml() -> Column:
    return by_lang(
        N.text.rlike(r"(?i)\bnoent\s*:\s*true\b"), python=N.text.rlike(r"\bresolve_entities\s*=\s*True\b|\bno_network\s*=\s*False\b"),
        java=N.text.rlike(r"(?i)setExpandEntityReferences\s*\(\s*true|(?:load-external-dtd|external-general-entities|external-parameter-entities)['\"]\s*,\s*true"),
        php=N.text.rlike(r"\bLIBXML_NOENT\b|(?i:libxml_disable_entity_loader\s*\(\s*false)"),
    )


def _slow() -> Column:
    op = by_lang(
        N.bare & (N.name == "RegExp"), python=N.on(["re"]) & N.name.isin("compile", "match", "search", "fullmatch", "sub", "split", "findall", "finditer"),
        go=N.on(["regexp"]) & N.name.isin("MustCompile", "Compile", "MatchString"), java=N.on(["Pattern"]) & (N.name == "compile"),
        php=N.bare & N.name.isin("preg_match", "preg_match_all", "preg_replace", "preg_split"),
    )
    return op & N.args.rlike(X.SLOW_PATTERN)


def _redirect() -> Column:
    js = F.coalesce(X.any_in(F.lower(N.object), ["res", "response", "reply", "ctx"]), F.lit(False)) & (N.name == "redirect")
    op = by_lang(
        js, python=N.bare & N.name.isin("redirect", "HttpResponseRedirect", "HttpResponsePermanentRedirect"), go=N.on(["http"]) & (N.name == "Redirect"),
        java=N.name == "sendRedirect", php=N.bare & (N.name == "header") & N.text.rlike(r"(?i)Location\s*:"),
    )
    return op & _user(N.text)


def _jwt() -> Column:
    verify = F.when(lang("php"), N.on(["JWT"]) & (N.name == "decode")).otherwise(N.name.isin("verify", "decode"))
    none = F.when(lang("php"), N.text.rlike(r"(?i)(?<![\w\]])\[[^\]]*['\"]none['\"]")).otherwise(N.text.rlike(r"(?i)algorithms\s*[:=]\s*\[[^\]]*['\"]none['\"]"))
    return verify & (none | lang("python") & N.text.rlike(r"verify_signature['\"]?\s*[:=]\s*False\b|\bverify\s*=\s*False\b"))


def builtin() -> list[Rule]:
    """All rules, in registration order."""
    shaped = F.when(N.any_child | N.text.contains("${"), 0.9).otherwise(0.6)
    ambiguous = F.when(N.name.isin("find", "find_one") & ~_where_value(), 0.5).otherwise(0.7)
    builder = F.when(N.on(["fmt"]) & (N.name == "Sprintf") | N.on(["String"]) & (N.name == "format"), 0.7).otherwise(0.8)
    script = [*JS, "python", "php"]
    rows = [
        ("CG-001", builder, "injection", ALL, N.call & _sql()),
        ("CG-002", 0.85, "injection", ALL, N.call & _shell()),
        ("CG-003", shaped, "injection", script, N.call & _eval()),
        ("CG-010", 0.75, "xss", [*JS, "python", "java"], _page()),
        ("CG-011", 0.85, "xss", JS, X.any_in(N.text, X.SOURCES) & X.any_in(N.text, X.SINKS)),
        ("CG-020", 0.7, "auth", ALL, (c("raw") == "hardcoded_credential") & X.is_secret(N.text)),
        ("CG-021", 0.85, "auth", ALL, N.call & _crypto()),
        ("CG-022", 0.65, "auth", ALL, N.call & by_lang(N.on(["Math"]) & (N.name == "random"), go=N.on(["rand"]) & N.name.isin(RANDOM_GO), java=N.bare & (N.name == "Random"), php=N.bare & N.name.isin("rand", "mt_rand"), python=N.on(["random"]) & N.name.isin(RANDOM_PY)) & near("secret")),
        ("CG-023", 0.7, "other", ALL, N.call & _slow()),
        ("CG-024", ambiguous, "injection", script, N.call & _mongo()),
        ("CG-025", 0.7, "other", ALL, N.call & _redirect()),
        ("CG-026", 0.8, "auth", script, N.call & _jwt()),
        ("CG-030", 0.75, "path", ALL, N.call & _paths()),
        ("CG-031", 0.8, "path", ALL, N.call & _files()),
        ("CG-040", 0.65, "data", ALL, N.call & _logs()),
        ("CG-041", F.when(lang("python") & N.name.isin("loads", "load"), 0.85).otherwise(0.8), "data", [*script, "java"], N.call & _load()),
        ("CG-050", 0.7, "config", ALL, X.misconfiguration(N.text).isNotNull()),
        ("CG-060", 0.75, "ssrf", ALL, N.call & _fetch()),
        ("CG-070", 0.75, "xxe", [*JS, "python", "java", "php"], N.call & _xml()),
    ]
    return [Rule(*meta, confidence, category, tuple(languages), test) for meta, (_, confidence, category, languages, test) in zip(META, rows, strict=True)]


#: Id, name, severity and weakness number of each rule.
META = [
    ("CG-001", "SQL Injection", "critical", 89),
    ("CG-002", "Command Injection", "critical", 78),
    ("CG-003", "Code Injection (eval)", "critical", 95),
    ("CG-010", "Cross-Site Scripting (XSS)", "high", 79),
    ("CG-011", "DOM-based XSS", "high", 79),
    ("CG-020", "Hardcoded Credentials", "high", 798),
    ("CG-021", "Weak Cryptography", "medium", 327),
    ("CG-022", "Insecure Randomness", "medium", 330),
    ("CG-023", "Insecure Regular Expression (ReDoS)", "medium", 1333),
    ("CG-024", "NoSQL Injection", "high", 943),
    ("CG-025", "Open Redirect", "medium", 601),
    ("CG-026", "JWT Signature Bypass", "critical", 347),
    ("CG-030", "Path Traversal", "high", 22),
    ("CG-031", "Arbitrary File Read/Write", "high", 73),
    ("CG-040", "Sensitive Data Exposure", "medium", 532),
    ("CG-041", "Insecure Deserialization", "high", 502),
    ("CG-050", "Security Misconfiguration", "medium", 693),
    ("CG-060", "Server-Side Request Forgery (SSRF)", "high", 918),
    ("CG-070", "XML External Entity (XXE)", "high", 611),
]
RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def load(preset: str = "all", custom: list[Rule] | None = None, disable: list[str] | None = None) -> list[Rule]:
    """The rules of a preset (`none`: only custom ones), without disabled ids; a repeated id is an error."""
    rules = ([] if preset == "none" else builtin()) + list(custom or [])
    ids = [r.id for r in rules]
    if repeated := sorted({i for i in ids if ids.count(i) > 1}):
        raise ValueError(f"rule ids repeat: {', '.join(repeated)}")
    return [r for r in rules if r.id not in set(disable or ())]


def match(nodes: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per node and rule that it meets: the node's place and text, rule_id, rule_ord, severity, cwe, confidence.

    Conditions are a projection, which Spark compiles; within the generator, or in a filter inferred from it, they would
    be interpreted or evaluated twice, so it gets a column, and gives nodes without a rule a null that is left out after it.
    """
    each = [
        F.when(c("lang").isin(*r.languages) & F.coalesce(r.test, F.lit(False)), F.struct(F.lit(r.id).alias("rule_id"), F.lit(k).alias("rule_ord"), F.lit(r.name).alias("rule_name"), F.lit(r.severity).alias("severity"), F.lit(r.cwe).alias("cwe"), (r.confidence if isinstance(r.confidence, Column) else F.lit(r.confidence)).cast("double").alias("confidence")))
        for k, r in enumerate(rules)
    ]
    hit = "struct<rule_id:string,rule_ord:int,rule_name:string,severity:string,cwe:int,confidence:double>"
    place = ["path", "lang", "ord", "kind", "text", "sl", "sc", "el", "ec", "name", "object", "context2", "context3"]
    met = nodes.where("error is null").select(*place, F.array(*each, F.lit(None).cast(hit)).alias("_met"))
    hits = met.select(*place, F.explode_outer(F.array_compact("_met")).alias("_hit")).where("_hit is not null")
    return hits.select(*place, "_hit.*")
