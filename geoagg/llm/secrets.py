"""Secret scans with a random forest against false positives (native).

A text is cut at every match of one candidate pattern: key blocks, cloud key ids, values assigned to a name, and long tokens
that hold a digit. Each candidate gets features: length, shares of digits, capitals and other marks, changes of character
class, different characters (of 64 at most), digits of a hexadecimal number only, share covered by dictionary words, marks
of a path in it, a test or example folder in the document's path, words of secrets, of checksums and of placeholders beside
it. A random forest trained on labelled findings scores them; what scores ``cutoff`` or more is a secret.

The forest is trained once by Spark's own learner and then written out as column expressions, so a scan is one pass without
a shuffle and a document never leaves its row. Labelled findings are a parameter; the default ones are made by
``labelled_findings``, ``TRAIN_ROWS`` rows at most are used.

Defined results: a null text stays null without findings; texts without candidates are unchanged; equal (text, path) have
equal results; empty tables give empty results; extra columns pass through, whatever their names, and columns of the input
named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, let, restored

#: Labelled findings that the forest is fitted on, at most.
TRAIN_ROWS = 4000
CUTOFF = 0.5
MARK = "[SECRET]"

#: Candidate pattern; the name and the sign before a value are part of the match.
NAME = r"""[A-Za-z_]{2,30}["']?\s?[=:]\s?["']?"""
SECRET_NAME = r"(?i:passw(?:or)?d|passwd|pwd|secret|token|api_?key|access_?key|auth(?:orization)?|credential)"
#: Every part ends where the token or the key block ends. Its repeats are possessive, and a bare token starts only where a run
#: of its characters starts, so a text is read a fixed number of times however long its tokens are.
CANDIDATE = (
    r"-----BEGIN [A-Z0-9 ]{0,20}PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z0-9 ]{0,20}PRIVATE KEY-----)?"
    rf"|{SECRET_NAME}[\"']?\s?[=:]\s?[\"']?[^\s\"']{{6,}}+"
    rf"|(?:(?<![A-Za-z0-9_+/.-])|(?<=KEY-----))(?:{NAME})?(?=[A-Za-z_+/.-]*+[0-9])[A-Za-z0-9_+/.-]{{16,}}+={{0,2}}+"
)
#: A text without any of these has no candidate.
HINT = r"[0-9]|PRIVATE KEY|(?i:passw|pwd|secret|token|key|auth|credential)"
#: Words that make up names, hosts and prose rather than keys.
DICTIONARY = "the and for with this that from have not you are was com org net www http https html example mail test index main name data file user page home image video news blog shop en de fr es php json xml css static public src lib bin usr var tmp version release build commit change version one two three tion ing ment able ness".split()
#: Words beside a candidate.
BESIDE = {
    "secret_word": r"(?i)\b(token|password|passwd|pwd|secret|api_?key|access_?key|credential|auth|bearer)\b",
    "checksum_word": r"(?i)\b(commit|sha1|sha256|md5|checksum|digest|etag|uuid|guid|revision|isbn|doi|build|version)\b",
    "example_word": r"(?i)(example|sample|dummy|changeme|placeholder|your[_-]|xxxx|0{8}|1234567|<.*>|\$\{|test|redacted)",
}
#: Columns that may say where a document is from, the first that there is counts.
PATHS = ("path", "source")
FEATURES = ["length", "digits", "capitals", "marks", "changes", "different", "hex", "covered", "path_like", "doc_path", *BESIDE, "assigned", "key_id"]


def value_of(match: Column) -> Column:
    """The candidate without the name and the sign before it."""
    return F.regexp_replace(match, rf"^(?:{SECRET_NAME}[\"']?\s?[=:]\s?[\"']?|{NAME})(?=[^\s\"'])", "")


def features(value: Column, before: Column, after: Column, path: Column) -> Column:
    """The struct of ``FEATURES``, all double, none null."""
    given = F.struct(value.alias("v"), before.alias("b"), after.alias("a"), F.coalesce(path, F.lit("")).alias("p"))
    return let(given, lambda g: _features(g["v"], g["b"], g["a"], g["p"]))


def _features(value: Column, before: Column, after: Column, path: Column) -> Column:
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    share = lambda c: F.length(F.regexp_replace(value, f"[^{c}]", "")) / n
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "b"), "[0-9]", "c")
    runs = F.regexp_replace(classes, r"(.)\1+", "$1")
    beside = F.concat_ws(" ", before, value, after)
    columns = {
        "length": n,
        "digits": share("0-9"),
        "capitals": share("A-Z"),
        "marks": share(r"_+/.=\-"),
        "changes": (F.length(runs) - 1) / n,
        "different": F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(64.0)),
        "hex": flag(value.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$") & value.rlike("[a-fA-F]")),
        "covered": 1 - F.length(F.regexp_replace(F.lower(value), "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / n,
        "path_like": flag(value.rlike(r"^[./]?[A-Za-z0-9_-]++(?:/[A-Za-z0-9_.-]++)++$|\.[a-z]{2,4}$")),
        "doc_path": flag(path.rlike(r"(?i)(^|[/_.-])(test|tests|example|examples|docs?|fixtures?)([/_.-]|$)")),
        "secret_word": flag(before.rlike(BESIDE["secret_word"])),
        "checksum_word": flag(before.rlike(BESIDE["checksum_word"])),
        "example_word": flag(beside.rlike(BESIDE["example_word"])),
        "assigned": flag(before.rlike(r"[=:]\s?[\"']?$")),
        "key_id": flag(value.rlike(r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^(?:ghp|gho|sk|pk|xox[abp])[_-][A-Za-z0-9_-]{16,}$|PRIVATE KEY")),
    }
    return F.struct(*[columns[k].cast("double").alias(k) for k in FEATURES])


# --- labelled findings -----------------------------------------------------------------------------------------------


def labelled_findings(spark: SparkSession, rows: int = TRAIN_ROWS, seed: int = 7) -> DataFrame:
    """Made findings (value, before, after, path, label 0/1), equally many of each of their forms, the same on every run."""
    bits = lambda k: F.sha2(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"), F.lit(k)), 256)
    hexes = F.concat(bits(1), bits(2))
    up = F.upper(F.translate(hexes, "0123456789abcdef", "QWERTZUP34567AXS"))
    mixed = F.translate(hexes, "0123456789abcdef", "aB3dE9gHkL7mNpQ2")
    low = F.translate(hexes, "0123456789abcdef", "tionedrhaslmpbuw")
    number = F.translate(hexes, "abcdef", "123456")
    length = lambda a, b: F.lit(a) + F.pmod(F.hash(bits(3)), F.lit(b - a + 1))
    cut = lambda c, a, b=None: F.substring(c, F.lit(1), length(a, b or a))
    word = F.substring(low, 20, 6)
    pick = lambda *xs: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), F.pmod(F.hash(bits(4)), F.lit(len(xs))) + 1)
    name = pick("token", "password", "secret", "api_key", "access_key", "auth", "passwd", "Password", "API_KEY")
    sign = pick(' = "', "=", ": ", ' = "', "='")
    said, other = F.concat(word, F.lit(" "), name, sign), F.concat(word, F.lit(" "), F.substring(low, 30, 5), F.lit(" "))
    plain = F.concat(pick("", '"', "'", '"'), F.lit(" "), F.substring(low, 36, 5))
    source = pick("src0", "src1", "lib/a.py", "app/config", "src7")
    trial = pick("tests/unit.py", "pkg/test/data", "docs/intro", "examples/run.sh", "spec/fixtures/keys")
    joke = F.concat(plain, pick(" (example)", " # placeholder", " <sample>", " is a dummy"))
    forms = [  # value, before, after, path, label
        (F.concat(F.lit("AKIA"), F.substring(up, 1, 16)), other, plain, source, 1),
        (F.concat(F.lit("AKIA"), F.substring(up, 1, 16)), said, plain, source, 1),
        (cut(hexes, 40), said, plain, source, 1),
        (cut(hexes, 16, 64), said, plain, source, 1),
        (cut(mixed, 16, 48), said, plain, source, 1),
        (cut(mixed, 8, 16), said, plain, source, 1),
        (cut(hexes, 16, 24), said, plain, source, 1),
        (F.concat(pick("ghp_", "sk_", "xoxb-"), cut(mixed, 24, 40)), other, plain, source, 1),
        (F.lit("-----BEGIN RSA PRIVATE KEY-----"), other, plain, source, 1),
        # the same shapes where they are no finding: in tests and examples, or named an example
        (cut(mixed, 8, 32), said, plain, trial, 0),
        (cut(hexes, 16, 40), said, plain, trial, 0),
        (cut(mixed, 8, 32), said, joke, source, 0),
        (cut(hexes, 40), F.concat(other, pick("commit ", "sha1 ", "revision ", "checksum: ")), plain, source, 0),
        (cut(hexes, 32), F.concat(other, pick("md5 ", "etag=", "digest ", "uuid ")), plain, source, 0),
        (F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)), other, plain, source, 0),
        (cut(number, 16, 19), other, plain, source, 0),
        (F.concat(pick("mail", "www", "blog", "cdn"), F.substring(number, 1, 1), F.lit("."), pick("example", word), pick(".com", ".org", ".net")), other, plain, source, 0),
        (F.concat(F.lit("/"), pick("usr", "home", "static", "blog"), F.lit("/"), word, F.lit("/"), F.substring(number, 1, 4), pick("/index.html", "/main.css", ".png")), other, plain, source, 0),
        (F.concat(cut(low, 14, 24), F.substring(number, 1, 2)), other, plain, source, 0),
        (F.concat(word, F.lit("."), word, F.lit("-"), F.substring(number, 1, 3), F.lit("."), F.substring(low, 3, 6)), other, plain, source, 0),
        (pick("changeme", "xxxxxxxxxxxx", "your_password_1", "your-token-here", "example1234567", "placeholder", "dummy-secret-00", "test1234567890"), said, plain, source, 0),
        (pick("required", "optional", "forgotten", "expired.", "invalid,", "reset-link", "protected"), said, plain, source, 0),
        (F.concat(F.lit("2024-"), F.substring(number, 1, 2), F.lit("-"), F.substring(number, 3, 2), F.lit("_"), F.substring(low, 1, 8)), other, plain, source, 0),
    ]
    made = F.array(*[F.struct(v.alias("value"), b.alias("before"), a.alias("after"), p.alias("path"), F.lit(float(y)).alias("label")) for v, b, a, p, y in forms])
    picked = F.element_at(made, (F.col("id") % len(forms) + 1).cast("int"))
    return spark.range(0, rows, 1, 1).select(picked.alias("x")).select("x.*")


# --- the forest ------------------------------------------------------------------------------------------------------


def _tree(node, at: Column) -> Column:
    """A fitted tree as an expression over the feature struct: the share of secrets in the leaf."""
    if node.getClass().getSimpleName() == "LeafNode":
        no, yes = list(node.impurityStats().stats())[:2]
        return F.lit(float(yes) / (float(no) + float(yes)))
    split = node.split()
    return F.when(at[FEATURES[split.featureIndex()]] <= F.lit(float(split.threshold())), _tree(node.leftChild(), at)).otherwise(_tree(node.rightChild(), at))


class Forest:
    """A fitted forest; ``score`` is its probability as an expression over the feature struct."""

    def __init__(self, model):
        self.model = model
        self.roots = [t._java_obj.rootNode() for t in model.trees]
        #: the features that splits use
        self.used = {f for f, share in zip(FEATURES, model.featureImportances.toArray(), strict=True) if share > 0}

    def score(self, at: Column) -> Column:
        total = F.lit(0.0)
        for root in self.roots:
            total = total + _tree(root, at)
        return total / len(self.roots)


def fit_forest(findings: DataFrame, trees: int = 15, depth: int = 5, seed: int = 7) -> Forest:
    """A forest from labelled findings (value, before, after, path, label); ``TRAIN_ROWS`` of them at most, by hash."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    own = findings.orderBy(F.xxhash64("value", "before"), "value", "before", "label").limit(TRAIN_ROWS).coalesce(1)
    own = own.select(features(F.col("value"), F.col("before"), F.col("after"), F.col("path")).alias("f"), "label").select("f.*", "label")
    own = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(own).select("features", "label")
    return Forest(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=2).fit(own))


ADDED = ("text", "n_candidates", "findings")


def secret_scan(docs: DataFrame, forest: Forest | None = None, path: str | None = None, cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` with ``text`` redacted, ``n_candidates`` and ``findings``: array of (value, score), secrets only.

    ``path``: the column that says where a document is from; by default the first of ``PATHS`` that there is.
    """
    forest = forest or fit_forest(labelled_findings(docs.sparkSession))
    path = path or next((p for p in PATHS if p in docs.columns), None)
    place = F.col(path).cast("string") if path else F.lit("")
    rows = docs.select(carried(docs, *ADDED), F.col("text"), place.alias("place"))
    text = F.col("text")
    matches = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    out = rows.withColumn("m", matches)
    out = out.withColumn("p", F.when(F.size("m") > 0, F.split(text, CANDIDATE, -1)))

    def described(m: Column, i: Column) -> Column:
        def with_value(value: Column) -> Column:
            before = F.concat(F.substring(F.get(F.col("p"), i), -40, 40), F.substring(m, F.lit(1), F.length(m) - F.length(value)))
            after = F.substring(F.coalesce(F.get(F.col("p"), i + 1), F.lit("")), 1, 24)
            return F.struct(m.alias("match"), value.alias("value"), features(value, before, after, F.col("place")).alias("f"))

        return let(value_of(m), with_value)

    out = out.withColumn("d", F.transform("m", described))
    out = out.withColumn("s", F.transform("d", lambda d: F.struct(d["match"].alias("match"), d["value"].alias("value"), let(d["f"], forest.score).alias("score"))))
    kept = lambda s: F.when(s["score"] >= cutoff, F.concat(F.substring(s["match"], F.lit(1), F.length(s["match"]) - F.length(s["value"])), F.lit(MARK))).otherwise(s["match"])
    joined = F.array_join(F.flatten(F.zip_with("p", "s", lambda p, s: F.array(p, F.coalesce(kept(s), F.lit(""))))), "")
    found = F.transform(F.filter("s", lambda s: s["score"] >= cutoff), lambda s: F.struct(s["value"].alias("value"), s["score"].alias("score")))
    return restored(
        out,
        F.when(F.size("m") > 0, joined).otherwise(text).alias("text"),
        F.coalesce(F.size("m"), F.lit(0)).cast("long").alias("n_candidates"),
        F.coalesce(found, F.array().cast("array<struct<value:string,score:double>>")).alias("findings"),
    )


def redacted(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced and ``n_chars``, if there, brought up to date."""
    out = secret_scan(docs.select(carried(docs).alias("_doc"), *[c for c in ("text", *PATHS) if c in docs.columns]), forest)
    out = out.withColumn("_row", F.col("_doc").withField("text", F.col("text")))
    if "n_chars" in docs.columns:
        n = F.when(F.size("findings") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc.n_chars"))
        out = out.withColumn("_row", F.col("_row").withField("n_chars", n))
    return out.select("_row.*")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = secret_scan(docs)
    return out.select("doc_id", "n_candidates", F.size("findings").cast("long").alias("n_secrets"), F.transform("findings", lambda x: x["value"]).alias("secrets"), F.round(F.coalesce(F.array_max(F.transform("findings", lambda x: x["score"])), F.lit(0.0)), 6).alias("score"), "text")


QUERIES = {"op8_secrets": op8_secrets}
ORACLE: dict[str, str] = {}
