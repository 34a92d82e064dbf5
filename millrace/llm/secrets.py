"""Secret scans: a random forest that removes false positives, as DataFrame expressions only.

A pattern finds candidates: runs of at least ``LEAST`` key characters with a digit, or right after a word such as
``password``; where such a word is assigned to, any run of ``SHORT`` or more characters without white space and
quotes; and passwords in URLs.  Each gets features of its length, character transitions, dictionary coverage, path and
neighbouring words on both sides.  A random forest, trained with Spark's own learner on labelled findings, is turned
into a nested CASE expression, so scanning a text is one projection inside the scan's stage: no Python, no shuffle.
Every step of it takes time in proportion to a text's length and candidates (their offsets: times its logarithm).

The dictionary is learned: the ``DICTIONARY`` most frequent words of letters of all texts, beside words of programs.
Labelled findings are a table (before, candidate, after, label).  ``labelled_findings`` makes one by rule: keys
of usual forms in assignments, headers and URLs against checksums, identifiers, numbers, paths, code and placeholders.

Edge cases: a null text stays null and has no findings; an empty text has none; texts of any length are scanned
whole; equal rows give equal findings; an empty table gives an empty result.  The column ``findings`` is
replaced (and ``text`` by redaction), all others pass through, whatever their names.
"""

from __future__ import annotations

import random
import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST, SHORT = 16, 6
AROUND = 48
PIECES = 2 * -(-AROUND // SHORT) + 1  # so many candidates and gaps between them have AROUND characters
TREES, DEPTH, SEED = 25, 6, 7
FINDINGS = 8000
DICTIONARY = 1000
REDACTED = "[SECRET]"
MARK = "\ufdd0"  # put around candidates; a text that holds it takes a slower way
#: Words before a secret, words before a checksum or identifier, and words of identifiers and placeholders.
KEY_WORDS = "password|passwd|pwd|passphrase|token|secret|secret[_ -]?key|api[_ -]?key|access_?key|auth|bearer|credential|private_?key"
HASH_WORDS = "commit|sha1|sha256|sha512|md5|checksum|digest|etag|revision|uuid|guid|hash|integrity|build|order|invoice|isbn|card"
WORDS = (
    "access|account|address|admin|after|all|and|api|app|array|auth|base|before|build|cache|change|class|client|code|config|data|"
    "date|default|demo|dev|dummy|env|error|example|fake|file|from|function|get|group|handler|here|home|http|index|insert|install|"
    "item|key|lib|list|local|log|login|main|manager|map|model|module|name|new|node|null|object|order|page|param|pass|password|path|"
    "placeholder|please|post|prod|python|query|read|replace|request|response|sample|secret|server|service|session|set|size|src|"
    "start|state|string|system|table|test|text|the|time|token|type|update|url|user|usr|value|version|view|with|work|write|your"
)
FEATURES = (
    "length", "transitions", "digits", "distinct", "words", "syllables", "upper", "path", "key_word", "hash_word", "assigned", "prefix", "uuid",
    "quoted", "code_after", "word_after", "address", "code",
)
PREFIXES = "AKIA|ASIA|gh[pousr]_|github_pat_|xox[abpsr]-|[srp]k_live_|glpat-|npm_|AIza|SG\\.|eyJ|hf_|dop_v1_"


def _assigned() -> str:
    """Pattern of the place right after a key word and an assignment; all looks behind have a fixed width."""
    names = "password|passwd|pwd|passphrase|token|secret|api_key|apikey|access_key|accesskey|auth|bearer|credential|private_key|privatekey"
    by_width: dict[int, list[str]] = {}
    for x in names.split("|"):
        by_width.setdefault(len(x), []).append(x)
    word = "|".join(f"(?<={'|'.join(own)})" for own in by_width.values())
    quote = "[\"'`]"
    after = [f"{sign}{blank}{q}" for sign in ("[=:]", "=>") for blank in ("", r"\s", r"\s\s", r"\s\s\s") for q in ("", quote)]
    whole = "|".join(f"(?<=(?:{word}){q}{blank}{own})" for own in after for blank in ("", r"\s", r"\s\s", r"\s\s\s") for q in ("", quote))
    near = "|".join(f"(?<={own})" for own in after)  # rules most places out at little cost
    return f"(?<=[=:>\\s\"'`])(?:{near})(?i:{whole})"


#: Keys of known forms and addresses are left to the last pattern, where they begin in the run's first 256 characters.
_PLAIN = rf"{_assigned()}(?![=:>])(?![^\s\"'`]{{0,256}}(?:AKIA|ASIA|gh[pousr]_|xox[abp]-|sk_live_|glpat-|://))[^\s\"'`]{{{SHORT - 1},}}[^\s\"'`,;.:)\]}}>]"
_IN_URL = rf"(?<=:)(?<=://[^\s:/@\"'`]{{1,40}}:)[^\s:/@\"'`]{{{SHORT},}}(?=@)"
_KEY = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}(?:={{1,2}}(?!=*['\"`]?[A-Za-z0-9+/_-]))?"  # padding, not the sign of an assignment
CANDIDATE = f"{_IN_URL}|{_PLAIN}|{_KEY}"
_ADDRESS = r"://[^\s:/@]{1,40}:$"


def counts(before: Column, candidate: Column) -> Column:
    """Whether a candidate is judged at all: one with a digit, or right after a key word or a URL's user."""
    return candidate.rlike("[0-9]") | F.lower(before).rlike(f"(?:{KEY_WORDS})[^a-z]*$") | before.rlike(_ADDRESS)


def dictionary(docs: DataFrame, text: str = "text", most: int = DICTIONARY) -> tuple[str, ...]:
    """Words of programs and the ``most`` most frequent words of 3 to 16 letters of all texts, of equals the first by name."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), r"[^a-z0-9_/+=\\-]+")).alias("w")).where(F.col("w").rlike("^[a-z]{3,16}$"))
    top = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(most).select("w").collect()
    return tuple(sorted({*WORDS.split("|"), *(r["w"] for r in top)}))


def _share(c: Column, pattern: str) -> Column:
    """The share of characters that the pattern's matches cover."""
    return F.lit(1.0) - F.length(F.regexp_replace(c, pattern, "")) / F.greatest(F.length(c), F.lit(1))


def features(before: Column, c: Column, after: Column, known: tuple[str, ...]) -> list[Column]:
    parts = F.regexp_extract_all(c, F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0))
    covered = F.aggregate(parts, F.lit(0), lambda total, x: total + F.when(F.lower(x).isin(*known), F.length(x)).otherwise(0))
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    count = lambda p: F.regexp_count(c, F.lit(p))
    flag = lambda x: x.cast("double")
    near = F.lower(F.right(before, F.lit(24)))
    return [
        F.length(c).cast("double"),
        (count("[a-z]+") + count("[A-Z]+") + count("[0-9]+") + count("[^A-Za-z0-9]+") - 1) / n,
        _share(c, "[0-9]"),
        F.size(F.array_distinct(F.split(c, ""))) / n,
        covered / n,
        F.regexp_count(F.lower(c), F.lit("[aeiouy][b-df-hj-np-tv-xz]")) / n,
        _share(c, "[A-Z]"),
        count("/") / n + flag(before.rlike(r"[/.\\]$")),
        flag(near.rlike(f"(?:{KEY_WORDS})(?:[^a-z]+(?:is|was))?[^a-z]*$")),
        flag(near.rlike(f"(?:{HASH_WORDS})[^a-z]*$")),
        flag(before.rlike(r"(?:[=:]|=>)\s*[\"'`]?$")),
        flag(c.rlike(f"^(?:{PREFIXES})")),
        flag(c.rlike("^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")),
        flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        flag(after.rlike(r"^[(\[{<.\\$]")),
        flag(after.rlike("^[ \n,;]*[a-z]{2,} [a-z]{2,}")),
        flag(before.rlike(_ADDRESS) & after.startswith("@")),
        flag(c.rlike(r"[(){}\[\]<>$%*]|\.[a-z]|^[.,;]|,")),
    ]


# --------------------------------------------------------------------------- training
def labelled_findings(spark: SparkSession, n: int = FINDINGS, known: tuple[str, ...] = (), first: int = 0) -> DataFrame:
    """``n`` labelled findings by rule, the same each time for the same dictionary; ``first`` begins another series."""
    words = [x for x in (known or tuple(WORDS.split("|"))) if len(x) > 3 and not re.search(f"{KEY_WORDS}|{HASH_WORDS}", x)]
    rows = [_finding(i, words) for i in range(first, first + n)]
    return spark.createDataFrame(rows, "before string, candidate string, after string, label double")


def _finding(i: int, words: list[str]) -> tuple[str, str, str, float]:
    """The i-th finding: the cases take turns, the rest is drawn."""
    rng = random.Random(i)
    pick = lambda *options: rng.choice(options)
    some = lambda alphabet, *sizes: "".join(rng.choices(alphabet, k=rng.choice(sizes)))
    letters, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    word = lambda: rng.choice(words)
    syllable = lambda: pick(*"bcdfglmnprstv", "ch", "st", "br") + pick(*"aeiou", "ou", "ea") + pick("", "n", "r", "s", "l", "m")
    neutral = word() + " " + word() + pick(" ", ". ", ", ", " ", "\n")
    follows = pick(" ", ", ", ". ", " ") + word() + " " + word()
    key = pick("password", "token", "secret", "api_key", "apikey", "access_key", "auth_token", "pwd", "client_secret", "Password", "TOKEN", "SECRET_KEY")
    long_key = pick("AWS_SECRET_ACCESS_KEY", "github_access_token", "DATABASE_PASSWORD", "production-api-key", "oauth2_client_secret", "SLACK_BOT_TOKEN_SECRET", "admin_user_password")
    ops = pick("=", ' = "', ": ", ':"', "='", ' = "', "=")
    quote = ops[-1] if ops[-1] in "\"'" else ""
    tail = quote + pick("", ",", "\n", " ", ";") if quote else pick("\n", " ", ", ", ";", follows)
    sign = pick(": ", ": ", " = ", "=")
    said = pick("the ", "my ", "a ", "this ") + pick("token", "password", "secret", "api key", "access token", "auth token") + pick(" ", " is ", ": ", " was ")
    password = pick("Tr0ub", "hunt3r", "S3cr", "p4ss", "w1nt", "L0nd", "dr4g", word().capitalize()) + pick("4dor", "er", "on", "et", "ka", "_", "99") + pick("&3", "!", "2x1", "#7", "$", "99")
    drawn = pick("", "", "Tr", "pa", "Zq") + some(letters, 6, 8, 9, 10, 12, 14) + pick("", "!", "&3", "#", "@9x") + pick("", "", "7", "K2")
    base = some(letters + "+/", 20, 28, 32, 40, 44, 64)
    prose = "".join(syllable() for _ in range(rng.randint(6, 9)))
    gap = pick("", "-", "_")
    glued = gap.join(word() for _ in range(rng.randint(3, 4)))
    camel = word() + "".join(word().capitalize() for _ in range(3)) + pick("", "2", "V3")
    names = ("user", "token", "value", "default", "config", "session", "account", "client", "service", "request", "access", "password", "handler", "example")
    ident = pick("_", "_", "-").join(rng.choices(names, k=4)) + pick("", "_2", "_v3", "01")
    fixed = "required optional undefined invalid string String, None,None <your-password> ${PASSWORD} {{password}} os.environ process.env.TOKEN changeme xxxxxxxx ******** getpass() self.token get_token(user) password example placeholder config.get(key) $DB_PASSWORD %(password)s Optional[str]"
    dummies = "xxxxxxxxxxxxxxxxxxxx your_api_key_goes_here 1234567890123456 0000000000000000 changeme_changeme AAAAAAAAAAAAAAAAAAAAAAAA example_token_value1"
    url = pick("postgres://", "https://", "mysql://", "amqp://", "redis://", "mongodb+srv://") + pick("admin", "root", "user", "app", word()) + ":"
    hashed = pick("commit ", "sha256:", "md5=", "checksum: ", "digest=", "etag: ", "revision ", "build=", 'hash = "')
    assigned = neutral + key + ops
    cases = [  # (before, candidate, after, label)
        (assigned, some(hexes, 16, 18, 20, 24, 32, 40, 40, 64), tail, 1),
        (assigned, some(hexes, 16, 18, 20, 32, 40).upper(), tail, 1),
        (assigned, some(letters, 16, 20, 24, 32, 40, 48), tail, 1),
        (assigned, base, tail, 1),
        (neutral + long_key + ops, pick(base, some(hexes, 20, 32, 40, 64)), tail, 1),
        (assigned, drawn, tail, 1),
        (assigned, word() + pick("1", "x1", "42", "2024", "7z", "&3", "!9", "$5e"), tail, 1),
        (assigned, password, tail, 1),
        (neutral + said, pick(some(letters, 20, 32, 40), some(hexes, 20, 32, 40, 40, 64)), follows, 1),
        (neutral + pick("Authorization: Bearer ", "authorization: bearer ", "Authorization: token ", "Authorization: Basic "), base, tail, 1),
        (neutral + url, pick(password, drawn).replace("@", "#"), "@" + word() + ".example/db", 1),
        (neutral, pick("AKIA", "ASIA") + some(string.ascii_uppercase + string.digits, 16), follows, 1),
        (neutral, pick("ghp_", "gho_", "sk_live_", "glpat-", "xoxb-", "npm_", "AIza", "hf_", "eyJ") + some(letters, 20, 36), follows, 1),
        (assigned, rng.choice(fixed.split(" ")), tail, 0),
        (neutral + key + sign, word() + pick("", "", "." + word()), follows, 0),
        (neutral + key + sign, word() + pick(".", "_", "::") + word() + pick("", "()", "[0]", "(x1)", ".v2"), pick("\n", "(", "[", ".get(", ")", ";"), 0),
        (neutral, long_key + pick("", "_2", "_V1", "01"), pick("=", ": ", " = "), 0),
        (neutral, some(string.digits, 16), follows, 0),
        (neutral + pick("card ", "order ", "isbn ", "invoice: ", ""), some(string.digits, 16, 17, 18, 20, 24), tail, 0),
        (neutral + hashed, some(hexes, 32, 40, 40, 64), tail, 0),
        (neutral, some(hexes, 16, 32, 40, 64), follows, 0),
        (neutral + pick("id=", "uuid: ", "request ", "guid ", "session "), "-".join(some(hexes, k) for k in (8, 4, 4, 4, 12)), tail, 0),
        (assigned, ident, tail, 0),
        (assigned, rng.choice(dummies.split(" ")), tail, 0),
        (neutral + pick("", key + " ", "class ", "def "), pick(glued, camel), pick("(", " ", ".", "\n", follows), 0),
        (neutral, prose, follows, 0),
        (neutral, prose.upper(), follows, 0),
        (neutral + pick("/", "./", "http://", "src/", ""), "/".join((pick("usr", "home", "src", "var"), word(), pick("lib", "data", "python3", "v2"), glued)), tail, 0),
    ]
    before, candidate, after, label = cases[i % len(cases)]
    return before, candidate, after, float(label)


def _tree(lines: list[str]) -> str:
    """SQL of a tree in Spark's description of it."""

    def node(at: int) -> tuple[str, int]:
        line = lines[at].strip()
        if line.startswith("Predict:"):
            return f"{float(line.split()[1])}D", at + 1
        m = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", line)
        yes, at = node(at + 1)
        no, at = node(at + 1)  # the line of Else
        return f"CASE WHEN f.{FEATURES[int(m[1])]} <= {float(m[2])!r}D THEN {yes} ELSE {no} END", at

    return node(0)[0]


def forest_sql(model) -> str:
    """The share of trees that vote for a secret, in terms of a struct ``f`` of features."""
    trees = [_tree([x for x in t.toDebugString.splitlines()[1:] if x.strip()]) for t in model.trees]
    return "(" + " + ".join(trees) + f") / {len(trees)}D"


@dataclass
class Model:
    """``forest``: SQL of the share of trees for a secret, in terms of a struct ``f``; ``known``: the dictionary."""

    forest: str
    known: tuple[str, ...]


def trained(docs: DataFrame, text: str = "text") -> Model:
    """Dictionary of all texts, and the forest fitted to findings made with it."""
    known = dictionary(docs, text)
    return train(labelled_findings(docs.sparkSession, known=known), known)


def train(findings: DataFrame, known: tuple[str, ...] = tuple(sorted(WORDS.split("|")))) -> Model:
    """A forest fitted to labelled findings (before, candidate, after, label)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    cols = features(F.col("before"), F.col("candidate"), F.col("after"), known)
    rows = findings.select("label", *(c.alias(n) for c, n in zip(cols, FEATURES, strict=True)))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("label", "features")
    learner = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", maxMemoryInMB=64)
    return Model(forest_sql(learner.fit(rows)), known)


# --------------------------------------------------------------------------- scanning
def _judged(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """(_row, _pieces, _found): the row, its text in turns of other text and candidate, and what is known of each candidate."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")  # so that no column can clash with those below
    parts = docs.select(row, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    own, between = F.regexp_extract_all("_t", F.lit(CANDIDATE), F.lit(0)), F.split("_t", CANDIDATE, -1)
    zipped = F.flatten(F.transform(F.arrays_zip(between.alias("b"), own.alias("c")), lambda x: F.array(x["b"], F.coalesce(x["c"], F.lit("")))))
    marked = F.split(F.regexp_replace("_t", F.lit(CANDIDATE), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    parts = parts.select("_row", F.when(F.contains(F.col("_t"), F.lit(MARK)), F.slice(zipped, 1, F.size(zipped) - 1)).otherwise(marked).alias("_pieces"))
    n = F.floor((F.size("_pieces") - 1) / 2).cast("int")
    # ends of the pieces: each round adds what stands 1, 2, 4, ... places before
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size("_pieces"))).cast("int") - 1)
    ends = F.aggregate(
        rounds,
        F.transform("_pieces", F.length),
        lambda total, k: F.transform(total, lambda x, i: x + F.coalesce(F.get(total, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0))),
    )
    edge = lambda cut: F.transform("_pieces", lambda x: cut(x, F.lit(AROUND)))
    # a lambda's variable, so that none of these is worked out again for each candidate
    held = F.struct(F.col("_pieces").alias("own"), ends.alias("ends"), edge(F.right).alias("tails"), edge(F.left).alias("heads"))
    near = lambda p, at, places: F.concat(*(F.coalesce(F.get(p, at + k), F.lit("")) for k in places))
    each = lambda p: F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            F.get(p["ends"], i * 2).alias("start"),
            F.right(near(p["tails"], i * 2 + 1, range(-PIECES, 0)), F.lit(AROUND)).alias("before"),
            F.get(p["own"], i * 2 + 1).alias("candidate"),
            F.left(near(p["heads"], i * 2 + 1, range(1, PIECES + 1)), F.lit(AROUND)).alias("after"),
        ),
    )
    found = F.flatten(F.transform(F.when(n > 0, F.array(held)).otherwise(F.array()), each))
    told = lambda x: F.struct(*(c.alias(k) for c, k in zip(features(x["before"], x["candidate"], x["after"], model.known), FEATURES, strict=True)))
    with_f = F.transform(found, lambda x: F.struct(x.alias("x"), F.when(counts(x["before"], x["candidate"]), told(x)).alias("f")))
    forest = re.sub(r"\bf\.", "y.f.", model.forest)
    scored = F.expr(f"transform(_f, y -> named_struct('x', y.x, 'score', CASE WHEN y.f IS NOT NULL THEN {forest} END))")
    final = F.transform(
        scored,
        lambda y: F.struct(*(y["x"][k].alias(k) for k in ("start", "before", "candidate", "after")), y["score"].alias("score"), (y["score"] >= 0.5).alias("secret")),
    )
    return parts.withColumn("_f", with_f).select("_row", "_pieces", final.alias("_found"))


def scan(docs: DataFrame, model: Model, text: str = "text", out: str = "findings") -> DataFrame:
    """``docs`` with an array of findings: start, before, candidate, after, score, secret."""
    judged = _judged(docs.drop(out), model, text)
    return judged.select("_row.*", F.filter("_found", lambda x: x["score"].isNotNull()).alias(out))


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with every secret replaced by a mark; other texts stay byte for byte."""
    judged = _judged(docs, model, text)
    gone = lambda i: (i % 2 == 1) & F.coalesce(F.get("_found", F.floor(i / 2).cast("int"))["secret"], F.lit(False))
    clean = F.array_join(F.transform("_pieces", lambda x, i: F.when(gone(i), F.lit(REDACTED)).otherwise(x)), "")
    some = F.exists("_found", lambda x: F.coalesce(x["secret"], F.lit(False)))
    before = F.col("_row")[text]
    return judged.select(*(F.when(some, clean).otherwise(before).alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns))


def secret_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: secrets are replaced by a mark; all documents and columns stay."""
    out = redact(docs, trained(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))
    return out.select(*docs.columns)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document, with the forest's score and verdict."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, trained(docs)).select("doc_id", F.inline("findings"))
    return found.select("doc_id", "start", F.length("candidate").alias("length"), "candidate", "score", F.col("secret").alias("is_secret"))
