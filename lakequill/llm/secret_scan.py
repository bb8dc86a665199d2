"""Secret scan: candidates by pattern, false positives removed by a random forest; DataFrame functions throughout.

A candidate is what a key word and a sign assign, whatever its characters, or a run of twelve or more key characters with
a digit in it, or of thirty-two without. The forest sees its length, how its characters change class and follow each
other, how much of it dictionary words cover, the path it lies under and the words around it. It is trained on labelled
findings; where a project has none of its own, a bounded set is made by rule from the usual formats.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.llm.common import column, text_of, written

KEY = r"(?i:token|secret|passw|passwd|passphrase|pwd|api.?key|access.?key|auth|credential|bearer|private.?key|signing.?key)"
#: Group 1 is the key word with its sign, empty for a run that stands by itself; the candidate is the rest of the match.
CANDIDATE = (
    rf"({KEY}[A-Za-z0-9_.\-]{{0,40}}[\"'`]?[ \t]{{0,4}}(?::=|=>|[:=])[ \t]{{0,4}}[\"'`]?)[^\s\"'`]{{3,}}[^\s\"'`.,;:!?()\[\]{{}}<>]"
    r"|(?<![A-Za-z0-9+/_.\-])(?=[A-Za-z+/_.\-]*+[0-9]|[A-Za-z0-9+/_.\-]{32})[A-Za-z0-9+/_.\-]{12,}={0,2}"
)
BEFORE, AFTER = 48, 24
#: Bound of the made training set.
FINDINGS = 6_000
TREES, DEPTH = 48, 8
#: Words that make up names, placeholders and identifiers rather than keys.
DICTIONARY = """about access account action active admin after agent alert alpha android answer array article asset author
backup batch before beta binary block board bucket buffer build button cache card change channel check class client cloud
code commit common company config content copy count create crypto current custom data date debug default delete demo
design detail device digest domain download draft driver dummy editor email empty engine entry error event example export
extra feature field figure file filter final flag folder format frame function github global group handler header hello
home host html http image import index info input install instance invoice issue item java json kernel label language
layer level library license limit line linux list local lock login main manager master member memory message meta method
mobile model module month name network node note number object offer office online option order output package page panel
parser part party path phone photo place placeholder player plugin point policy port post price print process product
profile project prompt proxy public python query queue random read record release remote render report request reset
response result review root route row rule sample schema scope screen script search section select serial server service
session setting sheet shop simple size source stack start state status store stream string style submit sum support
switch system table target task team template test text theme thread ticket time title total trace track train tree type
update upload user value vector version video view visit volume week window word work world worker your""".split()
#: Pairs of letters that follow each other in those words.
PAIRS = sorted({w[i : i + 2] for w in DICTIONARY for i in range(len(w) - 1)})
INNOCENT = r"(?i)(example|sample|dummy|placeholder|your|fake|hash|sha|md5|commit|checksum|digest|etag|uuid|guid|version|card|order|invoice|phone|isbn|serial|mail|url|http|file|image|revision|parcel)"
TEST_PATH = r"(?i)(test|spec|fixture|example|sample|mock|doc|lock|vendor|readme)"
FEATURES = ("length", "digits", "upper", "lower", "marks", "hex_only", "digits_only", "class_changes", "case_changes", "repeats", "vowel_turns", "longest_letters", "known_pairs", "distinct", "coverage", "test_path", "keyword", "innocent", "assigned", "quoted")


def features(df: DataFrame) -> DataFrame:
    """(candidate, before, after, path) with the feature columns."""
    c = F.col("candidate")
    n = F.length(c).cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    word = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    low = F.lower(c)
    return df.withColumns(
        {
            "length": F.least(n, F.lit(400.0)), "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"), "marks": share("[^A-Za-z0-9]"),
            "hex_only": c.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"), "digits_only": c.rlike("^[0-9.+-]+$").cast("double"),
            "class_changes": share("(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])"), "case_changes": share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
            "repeats": share(r"(?<=(.))\1"), "vowel_turns": share("(?i)(?<=[aeiou])(?=[bcdfghjklmnpqrstvwxyz])|(?<=[bcdfghjklmnpqrstvwxyz])(?=[aeiou])"),
            "longest_letters": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)), F.length)), F.lit(0)) / n,
            "known_pairs": F.coalesce(F.regexp_count(low, F.lit(f"(?=(?:{'|'.join(PAIRS)}))")) / F.nullif(F.regexp_count(low, F.lit("[a-z](?=[a-z])")), F.lit(0)), F.lit(0.0)),
            "distinct": F.size(F.array_distinct(F.split(F.left(c, F.lit(64)), ""))) / F.least(n, F.lit(64.0)), "coverage": 1 - F.length(F.regexp_replace(low, word, "")) / n, "test_path": F.coalesce(F.col("path").rlike(TEST_PATH), F.lit(False)).cast("double"),
            "keyword": F.col("before").rlike(KEY).cast("double"), "innocent": (F.col("before").rlike(INNOCENT) | F.col("after").rlike(INNOCENT)).cast("double"),
            "assigned": F.col("before").rlike(r"[=:]\s*[\"'`]?\s*$").cast("double"), "quoted": (F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).cast("double"),
        }
    )


def made_findings(spark: SparkSession, n: int = FINDINGS, seed: int = 3) -> DataFrame:
    """(candidate, before, after, path, is_secret): n findings made by rule, half of them secrets; the same ones every time."""
    digest = lambda k: F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(k), F.col("id").cast("string")), 256)
    base = spark.range(n).withColumns({"h": digest("h"), "g": digest("g")}).withColumns({"b64": F.regexp_replace(F.base64(F.unhex("h")), "[=\n]", ""), "digits": F.translate("h", "abcdef", "203948")}).withColumn("mixed", F.translate("b64", "+/", "Xy"))
    h, g, b64, digits, mixed = map(F.col, ("h", "g", "b64", "digits", "mixed"))
    roll = lambda k, m: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")), F.lit(m)).cast("int")
    choose = lambda k, xs: F.get(F.array(*map(F.lit, xs)), roll(k, len(xs)))
    words = lambda sep: F.concat_ws(sep, *(choose(f"w{k}", DICTIONARY) for k in range(3)))
    secrets = [
        F.left(h, (32 + 8 * roll("n", 2)).cast("int")), F.left(b64, (16 + roll("n", 26)).cast("int")), F.concat(choose("p", ["AKIA", "ASIA"]), F.upper(F.left(mixed, F.lit(16)))), F.left(mixed, (16 + roll("n", 24)).cast("int")),
        F.concat(choose("p", ["ghp_", "gho_", "sk-", "xoxb-", "glpat-", "pk_live_", "sk_live_", "AIza", "npm_"]), F.left(mixed, (24 + roll("n", 13)).cast("int"))), F.concat(F.lit("eyJ"), F.left(mixed, F.lit(33)), F.lit(".eyJ"), F.base64(F.unhex(F.left(g, F.lit(48))))),
    ]
    # What people choose themselves is a secret only after a key word.
    chosen = [F.concat(choose("w", DICTIONARY), F.left(F.translate(b64, "+/", "-_"), F.lit(8))), F.concat(F.initcap(choose("w0", DICTIONARY)), F.initcap(choose("w1", DICTIONARY)), F.initcap(choose("w2", DICTIONARY)), F.left(mixed, F.lit(4))), F.concat(F.left(mixed, F.lit(4)), choose("mark", ["!", "#", "@", "$", "%", "*"]), F.substring(mixed, 6, 6)), F.left(mixed, (9 + roll("n", 4)).cast("int"))]
    others = [
        F.left(digits, (12 + roll("n", 8)).cast("int")), F.concat_ws("-", F.left(h, F.lit(8)), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.left(h, (32 + 8 * roll("n", 5)).cast("int")),
        F.concat(words("_"), roll("n", 100).cast("string")), F.concat(words("-"), F.lit("."), roll("n", 10).cast("string"), F.lit("."), roll("m", 20).cast("string")), F.concat_ws("/", words("/"), F.concat(F.lit("v"), roll("n", 9).cast("string"))),
        F.concat(F.lit("20"), F.lpad(roll("n", 30).cast("string"), 2, "0"), F.lit("-"), F.lpad((roll("m", 12) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((roll("o", 28) + 1).cast("string"), 2, "0"), F.lit("T"), F.lpad(roll("q", 24).cast("string"), 2, "0")),
        F.concat_ws(".", *(roll(k, 256).cast("string") for k in "abcd")), F.concat(choose("w", DICTIONARY), F.lit("."), roll("n", 99).cast("string"), F.lit("@site"), roll("m", 9).cast("string"), F.lit(".example.org")),
        F.concat(choose("w0", DICTIONARY), F.initcap(choose("w1", DICTIONARY)), F.initcap(choose("w2", DICTIONARY)), F.initcap(choose("w3", DICTIONARY)), F.initcap(choose("w4", DICTIONARY))), F.concat_ws("-", F.left(digits, F.lit(3)), F.substring(digits, 4, 3), F.substring(digits, 7, 4)),
    ]
    # What stands where a secret could and is none: placeholders, references, calls, plain words.
    decoys = [
        F.concat(choose("y", ["your_", "my-", "some_", "<your-", "example-", "test_"]), words("_")), F.concat(F.lit("${"), F.upper(words("_")), F.lit("}")), F.concat(choose("w", DICTIONARY), F.lit("."), choose("w1", DICTIONARY), F.lit("("), choose("w2", DICTIONARY), F.lit(")")), F.repeat(choose("x", ["x", "*", "0", "X", "."]), (6 + roll("n", 20)).cast("int")),
        choose("w", DICTIONARY), F.concat(choose("w", DICTIONARY), F.lit("1234567890")), choose("v", ["None", "null", "true", "false", "undefined", "changeme", "string", "required", "password", "secret"]), words("_"), F.concat(F.lit("os.environ["), F.upper(choose("w", DICTIONARY)), F.lit("]")), F.concat_ws("/", F.lit(""), words("/")),
    ]
    pick = lambda k, xs: F.get(F.array(*xs), roll(k, len(xs)))
    key = choose("key", ["token", "secret", "api_key", "password", "auth_token", "access_key", "client_secret", "PRIVATE_KEY", "credentials", "API_KEY", "DB_PASSWORD", "pwd", "passphrase", "Bearer"])
    plain = choose("plain", ["order", "commit", "sha256", "etag", "version", "phone", "uuid", "checksum", "see", "the file", "revision", "invoice no", "called", "from", "of the", "and", "id", "build", "image"])
    neutral = choose("neutral", ["use", "with", "and", "here is", "value", "it is", "line", "set", "header", "x", "config", ""])
    sign = choose("sign", [" = \"", ": \"", "='", " = ", ": ", " := \"", "=", " => '"])
    lead = F.concat(choose("lead", ["", "the ", "set ", "export ", "of and ", "was, "]), choose("lead2", ["", "in ", "here ", "then "]))
    with_key = F.concat(lead, key, sign)
    without = F.concat(lead, plain, choose("gap", [" ", " ", " ", ": ", "=", " (", " #"]))
    unnamed = F.concat(lead, neutral, choose("gap2", [" ", " ", ": ", " = \"", " '", "\n"]))
    closing = lambda b: F.concat(F.when(b.rlike("[\"']$"), F.right(b, F.lit(1))).otherwise(""), choose("tail", [" and the", "", ";", ", of", " is", "\n"]))
    # Of ten: 3 keys after a key word, 1 chosen after one, 1 key that nothing names; 2 decoys after a key word, 3 others (two named as what they are).
    kind = roll("kind", 10)
    candidate = F.when((kind < 3) | (kind == 4), pick("s", secrets[1:])).when(kind == 3, pick("c", chosen)).when(kind < 7, pick("d", decoys)).otherwise(pick("o", others))
    candidate = F.when((kind < 3) & (roll("hex", 4) == 0), secrets[0]).otherwise(candidate)  # bare hexadecimal is a secret only after a key word
    before = F.when((kind < 4) | kind.isin(5, 6), with_key).when(kind.isin(4, 7), unnamed).otherwise(without)
    secret = kind < 5
    rows = base.select(
        candidate.alias("candidate"), before.alias("before"),
        F.when(secret, choose("path", ["src/app.py", "config/prod.env", "deploy.sh", "src0", "notes"])).otherwise(choose("path", ["tests/data.py", "docs/readme.md", "src/app.py", "package.lock", "src0"])).alias("path"), secret.alias("is_secret"), "id",
    )
    return rows.withColumn("after", closing(F.col("before"))).drop("id")


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> RandomForestClassificationModel:
    """A forest from labelled findings (candidate, before, after, path, is_secret); rows without a candidate or label are left out."""
    ready = features(findings.where("candidate is not null and is_secret is not null").na.fill("", ["before", "after"]))
    rows = _vectors(ready).select("features", F.col("is_secret").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=4, seed=seed, featureSubsetStrategy="sqrt").fit(rows)


def _vectors(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)


def _running(lengths: Column) -> Column:
    """Sums of the elements before each one. In pieces of the root of their number, so a text with very many candidates isn't a quadratic fold."""
    at = lambda xs, start: F.aggregate(xs, F.struct(start.cast("long").alias("at"), F.array().cast("array<bigint>").alias("all")), lambda s, x: F.struct((s["at"] + x).cast("long").alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")))["all"]
    wide = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(lengths)))).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.size(lengths) - 1) / wide).cast("int"))), lambda i: F.slice(lengths, i * wide + 1, wide))
    starts = at(F.transform(pieces, lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0))
    return F.flatten(F.zip_with(pieces, starts, at))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(id, path, start, end, candidate, before, after), a row for each candidate; offsets are code points."""
    text = text_of(column(docs, text_col))
    path = column(docs, path_col).cast("string") if path_col else F.lit(None).cast("string")
    found = docs.select(column(docs, id_col).alias("id"), path.alias("path"), text.alias("text")).where(F.col("text").rlike(CANDIDATE))
    hit = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    split = found.select("id", "path", F.split("text", CANDIDATE, -1).alias("rest"), hit.alias("hits"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(1)).alias("keys"))
    # What stands around: the text up to the neighbouring candidates, as much as is looked at.
    n = F.size("hits")
    starts = _running(F.zip_with(F.slice("rest", F.lit(1), n), F.col("hits"), lambda r, x: (F.length(r) + F.length(x)).cast("long")))
    tails = F.transform(F.slice("rest", F.lit(1), n), lambda r: F.struct(F.length(r).alias("n"), F.right(r, F.lit(BEFORE)).alias("text")))
    heads = F.transform(F.slice("rest", F.lit(2), n), lambda r: F.left(r, F.lit(AFTER)))
    rows = split.select("id", "path", F.explode(F.arrays_zip(starts.alias("at"), F.col("hits").alias("hit"), F.col("keys").alias("key"), tails.alias("tail"), heads.alias("after"))).alias("x"))
    start = F.col("x.at") + F.col("x.tail.n") + F.length("x.key")
    candidate = F.expr("substring(x.hit, length(x.key) + 1)")
    return rows.select("id", "path", start.alias("start"), (start + F.length(candidate)).alias("end"), candidate.alias("candidate"), F.right(F.concat("x.tail.text", "x.key"), F.lit(BEFORE)).alias("before"), F.col("x.after").alias("after"))


def secret_scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row for each candidate: id, start, end, candidate_sha256, score, secret (score >= 0.5). The candidates themselves aren't repeated in the result.

    findings: labelled ones to learn from, else the made ones. Null and empty texts have no candidates; texts are read
    whole; repeated rows repeat their findings; an empty table gives an empty result; equal candidates are found each time. Findings of one class only give a
    constant score.
    """
    spark = docs.sparkSession
    known = written(made_findings(spark) if findings is None else findings.select("candidate", "before", "after", "path", "is_secret"), "secret-findings")
    kinds = {r["is_secret"]: r["count"] for r in known.where("is_secret is not null").groupBy("is_secret").count().collect()}
    found = candidates(docs, id_col, text_col, path_col)
    if len(kinds) == 2:
        scored = train(known).transform(_vectors(features(found))).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = found.withColumn("score", F.lit(float(kinds.get(True, 0) > 0)))
    return scored.select(F.col("id").alias(id_col), "start", "end", F.sha2("candidate", 256).alias("candidate_sha256"), F.round("score", 6).alias("score"), (F.col("score") >= 0.5).alias("secret"))
