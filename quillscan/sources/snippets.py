"""A derived code corpus: our own snippets, one for each part key, with hand-written labels for tests and oracles.

The labels are never read by a scan; they are the expected side of comparisons only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.sources.tables import language_of


@dataclass(frozen=True)
class Snippet:
    ext: str
    content: str
    findings: tuple[tuple[str, int], ...] = ()  # rule, start line
    flows: tuple[tuple[int, int, str], ...] = ()  # source line, sink line, sink: within a function
    chains: tuple[tuple[int, int, int], ...] = ()  # source line, sink line, calls between: across functions
    edges: tuple[tuple[str, str, int], ...] = ()  # caller, callee, line
    pairs: tuple[tuple[int, int], ...] = field(default=())  # nearest source line, sink line: by lines alone


SNIPPETS = [
    Snippet(".js", "const id{k} = req.query.id;\nfunction load(db) {\n  return db.query(`SELECT * FROM t{k} WHERE id = ${id{k}}`);\n}\nlogger.info('ready {k}');\n", (("CG-001", 3),), pairs=((1, 3),)),
    Snippet(".js", "const cp = require('child_process');\nfunction run(name) {\n  cp.exec('ls {k} ' + name);\n  eval(name);\n}\nsetTimeout(() => run('x'), {k});\nsetTimeout('tick({k})', 10);\n", (("CG-002", 3), ("CG-003", 4), ("CG-003", 7))),
    Snippet(".ts", "function show{k}(el: HTMLElement, safe: string) {\n  render(el.innerHTML, safe);\n  paint(document.write, location.hash);\n  draw(safe);\n}\n", (("CG-010", 2), ("CG-010", 3), ("CG-011", 3))),
    Snippet(".js", "const password = 'hunter{k}two';\nconst token = process.env.TOKEN;\nconst secret = 'example-{k}';\nconst h = crypto.createHash('md5');\nconst n = crypto.createHash('sha256');\n", (("CG-020", 1), ("CG-021", 4))),
    Snippet(".ts", "function reset(n: number) {\n  const code = Math.random() * {k};\n  return code;\n}\nconst re = new RegExp('(a+)+{k}');\nconst ok = new RegExp('a+{k}');\n", (("CG-022", 2), ("CG-023", 5))),
    Snippet(".js", "users.find(req.body);\nusers.updateOne({ id: {k} }, req.body);\nusers.find({ id: {k} });\nres.redirect(req.query.next);\nres.redirect('/home/{k}');\n", (("CG-024", 1), ("CG-024", 2), ("CG-025", 4))),
    Snippet(".js", "jwt.verify(t, key{k}, { algorithms: ['none'] });\nfs.readFile('/data/{k}/' + name, done);\nfs.readFile(req.params.file, done);\nfs.readFile('/etc/app{k}.json', done);\n", (("CG-026", 1), ("CG-030", 2), ("CG-031", 3))),
    Snippet(".ts", "console.log('user password {k}', value);\nconsole.log('started {k}');\nstore.deserialize(blob{k});\nsession({ secure: false, id: {k} });\nparseXml(doc, { noent: true, id: {k} });\nfetch('https://h{k}/' + host);\nfetch('https://fixed/{k}');\n", (("CG-040", 1), ("CG-041", 3), ("CG-050", 4), ("CG-060", 6), ("CG-070", 5))),
    Snippet(".py", "import os\n\ndef handler{k}(request):\n    name = request.args.get('name')\n    os.system('ls {k} ' + name)\n    return name\n", (("CG-002", 5),), ((4, 5, "os.system"),), ((4, 5, 0),)),
    Snippet(".py", "def find(cursor, uid):\n    cursor.execute(f\"SELECT * FROM t{k} WHERE id = {uid}\")\n    cursor.execute('SELECT * FROM t{k} WHERE id = %s' % uid)\n    cursor.execute('SELECT {k} FROM t WHERE id = ?', (uid,))\n    eval(uid)\n", (("CG-001", 2), ("CG-001", 3), ("CG-003", 5))),
    Snippet(".py", "import pickle, yaml, random\n\ndef token(blob):\n    a = pickle.loads(blob)\n    b = yaml.load(blob, Loader=yaml.SafeLoader)\n    c = random.randint(0, {k})\n    return mark_safe(blob)\n", (("CG-010", 7), ("CG-022", 6), ("CG-041", 4))),
    Snippet(".py", "api_key = 'k3y-{k}-value'\nclient = requests.get('https://h{k}/' + host, verify=False)\npattern = re.compile('(x*)*{k}')\nsafe = re.compile('x*{k}')\ncipher = DES.new(key)\n", (("CG-020", 1), ("CG-021", 5), ("CG-023", 3), ("CG-050", 2), ("CG-060", 2))),
    Snippet(".py", "def outer{k}(request):\n    value = input('n')\n    inner(value)\n\ndef inner(arg):\n    os.system(arg)\n", (), (), ((2, 6, 1),), (("outer{k}", "inner", 3),)),
    Snippet(".go", "package main\n\nfunc Handle(w http.ResponseWriter, r *http.Request) {\n\tq := fmt.Sprintf(\"SELECT * FROM t{k} WHERE id=%s\", id)\n\tdb.Query(q)\n\texec.Command(\"sh\", \"-c\", \"ls {k} \" + dir)\n\tos.Open(r.FormValue(\"f{k}\"))\n\thttp.Redirect(w, r, r.FormValue(\"next\"), 302)\n}\n", (("CG-001", 4), ("CG-002", 6), ("CG-025", 8), ("CG-031", 7))),
    Snippet(".go", "package main\n\nfunc Conf() *tls.Config {\n\tpassword := \"s3cr3t{k}\"\n\tsum := md5.Sum(data)\n\tlog.Println(\"token {k}\", t)\n\treturn &tls.Config{InsecureSkipVerify: true}\n}\n", (("CG-020", 4), ("CG-021", 5), ("CG-040", 6), ("CG-050", 7))),
    Snippet(".java", "class A{k} {\n  void run(String x) throws Exception {\n    stmt.executeQuery(\"SELECT {k} FROM t WHERE a=\" + x);\n    Runtime.getRuntime().exec(\"ls {k} \" + x);\n    new File(\"/data/{k}/\" + x);\n    in.readObject();\n    stmt.executeQuery(\"SELECT {k} FROM t\");\n  }\n}\n", (("CG-001", 3), ("CG-002", 4), ("CG-030", 5), ("CG-041", 6))),
    Snippet(".java", "class B{k} {\n  void go(HttpServletRequest req, HttpServletResponse resp) throws Exception {\n    resp.sendRedirect(req.getParameter(\"n{k}\"));\n    MessageDigest.getInstance(\"MD5\");\n    cookie.setSecure(false);\n    Pattern.compile(\"(a*)+{k}\");\n    resp.getWriter().write(name);\n  }\n}\n", (("CG-010", 7), ("CG-021", 4), ("CG-023", 6), ("CG-025", 3), ("CG-050", 5))),
    Snippet(".php", "<?php\nfunction page($id) {\n  $r = $pdo->query(\"SELECT * FROM t{k} WHERE id = $id\");\n  system('ls {k} ' . $id);\n  header('Location: ' . $_GET['u']);\n  unserialize($id);\n  file_get_contents($_GET['f{k}']);\n  echo md5($id);\n}\n", (("CG-001", 3), ("CG-002", 4), ("CG-021", 8), ("CG-025", 5), ("CG-031", 7), ("CG-041", 6))),
    Snippet(".rb", "puts 'unsupported {k}'\n"),
    Snippet(".py", "import os\n\ndef quiet{k}(request):\n    a = input()\n    os.system('echo {k} ' + a)  # scan-ignore\n    # scan-ignore-next-line CG-003, CG-002\n    os.system('ls {k} ' + a)\n    os.system('rm {k} ' + a)  # scan-ignore CG-001\n", (("CG-002", 8),), ((4, 5, "os.system"), (4, 7, "os.system"), (4, 8, "os.system")), ((4, 5, 0), (4, 7, 0), (4, 8, 0)), (), ((4, 5), (4, 7), (4, 8))),
    Snippet(".js", "// clean file {k}\nexport function add(a, b) {\n  return a + b;\n}\nconst title = 'a' + 'b';\nfeedback.query(`x ${title}`);\n"),
]
#: Labels of every call: by snippet, line, name, receiver and arguments. Tests hold them against Python's own parser, and those of other languages against the text by patterns.
CALLS = {
    0: ((3, 'query', 'db', '`SELECT * FROM t{k} WHERE id = ${id{k}}`'), (5, 'info', 'logger', "'ready {k}'")),
    1: ((1, 'require', None, "'child_process'"), (3, 'exec', 'cp', "'ls {k} ' + name"), (4, 'eval', None, 'name'), (6, 'setTimeout', None, "() => run('x')", '{k}'), (6, 'run', None, "'x'"), (7, 'setTimeout', None, "'tick({k})'", '10')),
    2: ((2, 'render', None, 'el.innerHTML', 'safe'), (3, 'paint', None, 'document.write', 'location.hash'), (4, 'draw', None, 'safe')),
    3: ((4, 'createHash', 'crypto', "'md5'"), (5, 'createHash', 'crypto', "'sha256'")),
    4: ((2, 'random', 'Math'), (5, 'RegExp', None, "'(a+)+{k}'"), (6, 'RegExp', None, "'a+{k}'")),
    5: ((1, 'find', 'users', 'req.body'), (2, 'updateOne', 'users', '{ id: {k} }', 'req.body'), (3, 'find', 'users', '{ id: {k} }'), (4, 'redirect', 'res', 'req.query.next'), (5, 'redirect', 'res', "'/home/{k}'")),
    6: ((1, 'verify', 'jwt', 't', 'key{k}', "{ algorithms: ['none'] }"), (2, 'readFile', 'fs', "'/data/{k}/' + name", 'done'), (3, 'readFile', 'fs', 'req.params.file', 'done'), (4, 'readFile', 'fs', "'/etc/app{k}.json'", 'done')),
    7: ((1, 'log', 'console', "'user password {k}'", 'value'), (2, 'log', 'console', "'started {k}'"), (3, 'deserialize', 'store', 'blob{k}'), (4, 'session', None, '{ secure: false, id: {k} }'), (5, 'parseXml', None, 'doc', '{ noent: true, id: {k} }'), (6, 'fetch', None, "'https://h{k}/' + host"), (7, 'fetch', None, "'https://fixed/{k}'")),
    8: ((4, 'get', 'request.args', "'name'"), (5, 'system', 'os', "'ls {k} ' + name")),
    9: ((2, 'execute', 'cursor', 'f"SELECT * FROM t{k} WHERE id = {uid}"'), (3, 'execute', 'cursor', "'SELECT * FROM t{k} WHERE id = %s' % uid"), (4, 'execute', 'cursor', "'SELECT {k} FROM t WHERE id = ?'", '(uid,)'), (5, 'eval', None, 'uid')),
    10: ((4, 'loads', 'pickle', 'blob'), (5, 'load', 'yaml', 'blob', 'Loader=yaml.SafeLoader'), (6, 'randint', 'random', '0', '{k}'), (7, 'mark_safe', None, 'blob')),
    11: ((2, 'get', 'requests', "'https://h{k}/' + host", 'verify=False'), (3, 'compile', 're', "'(x*)*{k}'"), (4, 'compile', 're', "'x*{k}'"), (5, 'new', 'DES', 'key')),
    12: ((2, 'input', None, "'n'"), (3, 'inner', None, 'value'), (6, 'system', 'os', 'arg')),
    13: ((4, 'Sprintf', 'fmt', '"SELECT * FROM t{k} WHERE id=%s"', 'id'), (5, 'Query', 'db', 'q'), (6, 'Command', 'exec', '"sh"', '"-c"', '"ls {k} " + dir'), (7, 'Open', 'os', 'r.FormValue("f{k}")'), (7, 'FormValue', 'r', '"f{k}"'), (8, 'Redirect', 'http', 'w', 'r', 'r.FormValue("next")', '302'), (8, 'FormValue', 'r', '"next"')),
    14: ((5, 'Sum', 'md5', 'data'), (6, 'Println', 'log', '"token {k}"', 't')),
    15: ((3, 'executeQuery', 'stmt', '"SELECT {k} FROM t WHERE a=" + x'), (4, 'exec', 'Runtime.getRuntime()', '"ls {k} " + x'), (4, 'getRuntime', 'Runtime'), (5, 'File', None, '"/data/{k}/" + x'), (6, 'readObject', 'in'), (7, 'executeQuery', 'stmt', '"SELECT {k} FROM t"')),
    16: ((3, 'sendRedirect', 'resp', 'req.getParameter("n{k}")'), (3, 'getParameter', 'req', '"n{k}"'), (4, 'getInstance', 'MessageDigest', '"MD5"'), (5, 'setSecure', 'cookie', 'false'), (6, 'compile', 'Pattern', '"(a*)+{k}"'), (7, 'write', 'resp.getWriter()', 'name'), (7, 'getWriter', 'resp')),
    17: ((3, 'query', '$pdo', '"SELECT * FROM t{k} WHERE id = $id"'), (4, 'system', None, "'ls {k} ' . $id"), (5, 'header', None, "'Location: ' . $_GET['u']"), (6, 'unserialize', None, '$id'), (7, 'file_get_contents', None, "$_GET['f{k}']"), (8, 'md5', None, '$id')),
    19: ((4, 'input', None), (5, 'system', 'os', "'echo {k} ' + a"), (7, 'system', 'os', "'ls {k} ' + a"), (8, 'system', 'os', "'rm {k} ' + a")),
    20: ((6, 'query', 'feedback', '`x ${title}`'),),
}
#: Labels of functions and classes: by snippet, their numbers. Counted by eye.
SPANS = {
    0: (1, 0),
    1: (2, 0),
    2: (1, 0),
    3: (0, 0),
    4: (1, 0),
    5: (0, 0),
    6: (0, 0),
    7: (0, 0),
    8: (1, 0),
    9: (1, 0),
    10: (1, 0),
    11: (0, 0),
    12: (2, 0),
    13: (1, 0),
    14: (1, 0),
    15: (1, 1),
    16: (1, 1),
    17: (1, 0),
    19: (1, 0),
    20: (1, 0),
}
#: Word of the suppression directive in the corpus.
DIRECTIVE = "scan-ignore"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, lang and content, one file for each part; the snippet of a part follows from its key."""
    rows = [(k, s.ext, s.content) for k, s in enumerate(SNIPPETS)]
    kinds = F.broadcast(spark.createDataFrame(rows, "template int, ext string, body string"))  # a fixed list
    keys = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    keys = keys.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")  # contents are made, and parsed, by every core; only keys move
    part = keys.withColumn("template", (F.col("p_partkey") % len(SNIPPETS)).cast("int"))
    path = F.concat(F.lit("src/m"), F.col("p_size").cast("string"), F.lit("/f"), F.col("p_partkey").cast("string"), F.col("ext"))
    made = part.join(kinds, "template").select(path.alias("path"), F.regexp_replace("body", r"\{k\}", F.col("p_partkey").cast("string")).alias("content"))
    return made.select("path", language_of(F.col("path")).alias("lang"), "content")


def _sql(*rows: tuple) -> str:
    one = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


_PATH = "'src/m' || p_size || '/f' || p_partkey || ext"
_PARTS = f"part JOIN {_sql(*((k, s.ext) for k, s in enumerate(SNIPPETS)))} t(template, ext) ON p_partkey % {len(SNIPPETS)} = template"


def expected(kind: str, columns: str, select: str) -> str:
    """SQL for labels of the corpus: `select` over part and the labels of a kind, with column path."""
    rows = [(k, *r) for k, s in enumerate(SNIPPETS) for r in getattr(s, kind)]
    return f"SELECT {_PATH} AS path, {select} FROM {_PARTS} JOIN {_sql(*rows)} x(x_template, {columns}) ON x_template = template"
