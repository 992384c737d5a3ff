"""Rules on one-line programs, positive and negative, by language."""

import pytest

from quillscan.operators import parse, rules

CASES = [
    ("javascript", "db.query(`select ${a}`)", "CG-001", True),
    ("javascript", "feedback.query(`select ${a}`)", "CG-001", False),
    ("javascript", "db.query('select ?' + tail, [a])", "CG-001", False),
    ("python", "cursor.execute('SELECT %s' % a)", "CG-001", True),
    ("python", "cursor.execute('SELECT 1 FROM t WHERE a LIKE \\'%x%\\'')", "CG-001", False),
    ("go", 'package p\nfunc f() { x := fmt.Sprintf("DELETE FROM %s", t) }', "CG-001", True),
    ("java", 'class A { void f() { String s = String.format("hello %s", t); } }', "CG-001", False),
    ("php", '<?php pg_query("SELECT $a"); ?>', "CG-001", True),
    ("python", "subprocess.run('ls ' + a)", "CG-002", True),
    ("python", "photos.system('ls ' + a)", "CG-002", False),
    ("java", 'class A { void f() { new ProcessBuilder("sh " + a); } }', "CG-002", True),
    ("javascript", "setTimeout(function () { x('a' + b) }, 1)", "CG-003", False),
    ("javascript", "emitter.setTimeout('run()', 1)", "CG-003", False),
    ("python", "model.eval()", "CG-003", True),
    ("python", "exec(code)", "CG-003", True),
    ("python", "db.exec(code)", "CG-003", False),
    ("python", "Markup('<b>')", "CG-010", False),
    ("python", "Markup(name)", "CG-010", True),
    ("java", 'class A { void f() { PrintWriter out = resp.getWriter();\nout.println(name); } }', "CG-010", True),
    ("typescript", "set(x.innerHTML, window.name)", "CG-011", True),
    ("go", 'package p\nfunc f() { token := "abcdef" }', "CG-020", True),
    ("python", "DB_PASSWORD = 'abcdef'", "CG-020", False),
    ("python", "password = '${HOLE}'", "CG-020", False),
    ("javascript", "crypto.createCipheriv('aes-128-ecb', k, v)", "CG-021", True),
    ("java", 'class A { void f() { Cipher.getInstance("AES/GCM/NoPadding"); } }', "CG-021", False),
    ("python", "hashlib.new('sha1')", "CG-021", True),
    ("javascript", "const sessionId = Math.random()", "CG-022", True),
    ("javascript", "const width = Math.random()", "CG-022", False),
    ("php", "<?php $otp = mt_rand(1, 9); ?>", "CG-022", True),
    ("go", 'package p\nfunc f() { regexp.MustCompile("(a|b+)*") }', "CG-023", True),
    ("php", "<?php $c->deleteMany($_POST); ?>", "CG-024", True),
    ("javascript", "users.find({ $where: `this.a == ${x}` })", "CG-024", True),
    ("javascript", "find(req.body)", "CG-024", False),
    ("python", "redirect(request.args.get('n'))", "CG-025", True),
    ("python", "jwt.decode(t, options={'verify_signature': False})", "CG-026", True),
    ("php", "<?php JWT::decode($t, $k, ['none']); ?>", "CG-026", True),
    ("javascript", "const p = path.resolve(a)\nif (p.startsWith(root)) fs.readFile('x/' + b)", "CG-030", False),
    ("python", "name = request.args.get('f')\nopen(name)", "CG-031", True),
    ("php", "<?php $f = $_GET['f'];\nreadfile($f); ?>", "CG-031", True),
    ("go", 'package p\nfunc f() { logger.Infof("password %s", p) }', "CG-040", True),
    ("javascript", "catalog.push('title')", "CG-040", False),
    ("python", "yaml.load(x)", "CG-041", True),
    ("python", "json.loads(x)", "CG-041", False),
    ("java", 'class A { void f() { http.csrf().disable(); } }', "CG-050", True),
    ("php", "<?php curl_setopt($c, CURLOPT_SSL_VERIFYPEER, false); ?>", "CG-050", True),
    ("javascript", "axios.get(`https://x/${y}`)", "CG-060", True),
    ("javascript", "router.get('/a' + b)", "CG-060", False),
    ("java", 'class A { void f() { new URL("https://" + h); } }', "CG-060", True),
    ("python", "etree.XMLParser(resolve_entities=True)", "CG-070", True),
    ("php", "<?php simplexml_load_string($x, null, LIBXML_NOENT); ?>", "CG-070", True),
]


@pytest.fixture(scope="module")
def matched(spark):
    files = spark.createDataFrame([(str(k), lang, text) for k, (lang, text, _, _) in enumerate(CASES)], "path string, lang string, content string")
    return {(int(r["path"]), r["rule_id"]) for r in rules.match(parse.nodes(files), rules.load()).collect()}


@pytest.mark.parametrize("k", range(len(CASES)), ids=[f"{c[2]}-{c[0]}-{k}" for k, c in enumerate(CASES)])
def test_rule(matched, k):
    lang, text, rule, want = CASES[k]
    assert ((k, rule) in matched) == want, (lang, text, sorted(r for i, r in matched if i == k))


def test_registry():
    assert len(rules.META) == 19 == len({m[0] for m in rules.META})


def test_presets(spark):
    assert rules.load("none") == []
    assert len(rules.load(disable=["CG-001"])) == 18
    with pytest.raises(ValueError):
        rules.load(custom=[rules.builtin()[0]])
