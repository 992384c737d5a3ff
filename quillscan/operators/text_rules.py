"""Line-level detectors and text functions that need no parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillscan.sources.shared import dealt

#: Fixed values (one look-ahead for a hole is folded into the value's first character, as the oracle's engine has none): a secret's name, its assignment and a value that isn't a hole to fill in; words that mark a dummy.
SECRET = r"(?i)(?:password|passwd|secret|api[_-]?key|token|credential|auth[_-]?token|private[_-]?key)\s*(?::=|[:=])\s*['\"`][^'\"`\s${}][^'\"`]{2,}['\"`]"
DUMMY = ["process.env", "os.environ", "placeholder", "example", "xxx", "changeme"]
LITERAL = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`"
#: Page sinks and sources of script injection; the nested quantifier of a slow pattern.
SINKS = ["innerHTML", "outerHTML", "insertAdjacentHTML", "document.write", "document.writeln"]
SOURCES = ["location.hash", "location.search", "location.href", "document.URL", "document.referrer", "window.name", "document.cookie"]
SLOW_PATTERN = r"\([^()]*[+*][^()]*\)[+*]"
#: Configuration patterns in order of precedence.
MISCONFIGURED = [
    (r"(?i)cors.*origin.*['\"`]\*['\"`]", "CORS wildcard origin"),
    (r"(?i)access-control-allow-origin[\"'\s:,)]+\*", "CORS wildcard origin (header)"),
    (r"_create_unverified_context\s*\(", "TLS verification disabled (Python unverified context)"),
    (r"\bCERT_NONE\b", "TLS verification disabled (Python CERT_NONE)"),
    (r"(?i)secure\s*:\s*false", "Secure flag disabled"),
    (r"(?i)httpOnly\s*:\s*false", "HttpOnly flag disabled"),
    (r"(?i)sameSite\s*:\s*['\"`]none['\"`]", "SameSite=None"),
    (r"(?i)helmet\s*\(\s*\{[^}]*contentSecurityPolicy\s*:\s*false", "CSP disabled"),
    (r"(?i)DEBUG\s*=\s*True", "Debug mode enabled"),
    (r"(?i)verify\s*=\s*False", "SSL verification disabled"),
    (r"(?i)rejectUnauthorized\s*:\s*false", "TLS verification disabled"),
    (r"InsecureSkipVerify\s*:\s*true", "TLS verification disabled (Go)"),
    (r"\.csrf\(\s*\)\s*\.disable\(\s*\)", "CSRF protection disabled (Spring)"),
    (r"\.allowedOrigins\(\s*[\"'`]\*[\"'`]", "CORS wildcard origin (Spring)"),
    (r"\bsetSecure\(\s*false\s*\)", "Secure cookie flag disabled (Java)"),
    (r"\bsetHttpOnly\(\s*false\s*\)", "HttpOnly flag disabled (Java)"),
    (r"(?i)CURLOPT_SSL_VERIFY(?:PEER|HOST)\s*,\s*(?:false|0)\b", "TLS verification disabled (PHP curl)"),
    (r"(?i)display_errors['\"]?\s*(?:,|=)\s*['\"]?1\b", "Debug mode enabled (PHP)"),
]


#: A word that each of the patterns needs: most texts have none and are told apart at once.
_CONFIGURES = r"(?i)cors|access-control|_create_unverified|cert_none|secure|httponly|samesite|helmet|debug|verify|rejectunauthorized|csrf|allowedorigins|curlopt|display_errors"


def any_in(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def is_secret(text: Column) -> Column:
    return text.rlike(SECRET) & ~any_in(F.lower(text), DUMMY)


def misconfiguration(text: Column) -> Column:
    """The name of the first pattern that the text has, or null."""
    return F.when(text.rlike(_CONFIGURES), F.coalesce(*[F.when(text.rlike(p), F.lit(n)) for p, n in MISCONFIGURED]))


def strip_literals(text: Column) -> Column:
    """The text with a placeholder, U+FFFF, for each string literal."""
    return F.regexp_replace(text, LITERAL, "￿")


def has_dynamic_part(text: Column) -> Column:
    return strip_literals(text).rlike(r"[\p{L}\p{N}_$]")


def finding_id(prefix: Column, *fields: Column) -> Column:
    """A stable id: twelve hexadecimal digits of the SHA-256 of the fields joined by NUL."""
    return F.concat(prefix, F.lit("-"), F.substring(F.sha2(F.concat_ws("\0", *fields), 256), 1, 12))


def fingerprint(rule: Column, file: Column, snippet: Column) -> Column:
    """What a baseline knows a finding by: rule, file and the snippet without regard to white space; no line."""
    return F.sha2(F.concat_ws("\0", rule, file, F.trim(F.regexp_replace(snippet, r"\s+", " "))), 256)


def context_frame(lined: DataFrame, key: str, radius: int) -> DataFrame:
    """Each line with `context`: the lines up to radius before and after it in its file, joined."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(-radius, radius)
    return lined.withColumn("context", F.array_join(F.collect_list("line").over(w), "\n"))


def expectations(lined: DataFrame, word: str = "scan-expect", rows: int = 0) -> DataFrame:
    """file, line and rule_id that comments of the form `word RULE, RULE` expect; of lines (file, line_no, line). rows: how many there are about, if known; tasks follow."""
    listed = F.regexp_extract("line", word + r"[:\s]+([A-Za-z]+-\d+(?:[\s,]+[A-Za-z]+-\d+)*)", 1)
    rules = lined.where(F.col("line").contains(word)).select("file", F.col("line_no").alias("line"), F.explode(F.split(F.upper(listed), r"[\s,]+")).alias("rule_id"))
    return dealt(rules.where("rule_id <> ''"), "file", "line", "rule_id", rows=rows).distinct()


def scores(found: DataFrame, expected: DataFrame, rows: int = 0) -> DataFrame:
    """One row: hits, false alarms, misses, precision and recall of findings against expectations, by file, line and rule. rows: as of `expectations`."""
    keys = ["file", "line", "rule_id"]
    a = dealt(found.select(*keys), *keys, rows=rows).distinct().withColumn("_f", F.lit(1))
    both = a.join(expected.select(*keys).distinct().withColumn("_e", F.lit(1)), keys, "full")
    n = both.agg(F.count_if(F.col("_f").isNotNull() & F.col("_e").isNotNull()).alias("tp"), F.count_if(F.col("_e").isNull()).alias("fp"), F.count_if(F.col("_f").isNull()).alias("fn"))
    share = lambda rest: F.col("tp") / F.nullif(F.col("tp") + F.col(rest), F.lit(0))
    return n.withColumn("precision", share("fp")).withColumn("recall", share("fn"))


def triage(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """One row on how a second stage judges findings: verdicts (file, line, rule_id, confirmed) against labels (file, line, rule_id, is_real).

    labelled, confirm_recall (real ones confirmed), dismiss_rate (false ones dismissed) and accuracy are over labels;
    wrong counts labels judged the other way, unlabelled the judged places without a label, silent the labels without a
    verdict. Rows that repeat a place count once, confirmed if one of them is, real if one of them is; a null verdict
    or label is none. Rates over nothing are null.
    """
    keys = ["file", "line", "rule_id"]
    judged = verdicts.where("confirmed is not null").groupBy(*keys).agg(F.bool_or("confirmed").alias("_yes"))
    known = labels.where("is_real is not null").groupBy(*keys).agg(F.bool_or("is_real").alias("_real"))
    same = [judged[k].eqNullSafe(known[k]) for k in keys]
    yes, real = F.col("_yes"), F.col("_real")
    n = judged.join(known, same, "full").agg(
        F.count(real).alias("labelled"), F.count_if(real).alias("_n_real"), F.count_if(~real).alias("_n_false"), F.count_if(real & yes).alias("_confirmed"), F.count_if(~real & ~yes).alias("_dismissed"),
        F.count_if(real != yes).alias("wrong"), F.count_if(real.isNull()).alias("unlabelled"), F.count_if(yes.isNull()).alias("silent"),
    )
    share = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    right = (F.col("_confirmed") + F.col("_dismissed")) / F.nullif(F.col("labelled"), F.lit(0))
    return n.select("labelled", share("_confirmed", "_n_real").alias("confirm_recall"), share("_dismissed", "_n_false").alias("dismiss_rate"), right.alias("accuracy"), "wrong", "unlabelled", "silent")
