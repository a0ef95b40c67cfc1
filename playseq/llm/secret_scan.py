"""Secret scan: pattern candidates, and a random forest that removes false findings.

Everything is DataFrame expressions and Spark's own forest; no Python runs on the executors. A candidate is a run of
key-like characters with a digit, or any value of six or more characters directly after a credential word and : or =. The forest sees its length, its character transitions, how much of it dictionary words
cover, its path and the words around it. It is trained on labelled findings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playseq.operators.storage import BROADCAST_ROWS, local_table, written

# A credential word, : or = (or both), and a quote that may stand before the value; bounded, as it is looked for behind values.
_WORD = "token|secret|passw(?:or)?d|passphrase|passwd|pwd|api[_-]?key|access[_-]?key|auth|authorization|bearer|credential|private[_-]?key"
_TO = rf"(?i:{_WORD})s?[\"'\])]{{0,2}}\s{{0,2}}[:=]{{1,2}}\s{{0,2}}"
#: A value assigned to a credential: all of a quoted one, or a run without spaces and quotes.
GIVEN = rf"""(?<=")(?<={_TO}")[^"\r\n]{{6,}}+(?=")|(?<=')(?<={_TO}')[^'\r\n]{{6,}}+(?=')|(?<=[:=\s"'`])(?<={_TO}["'`]?)(?![:=])[^\s"'`]{{6,}}+"""
#: Or a run of at least 12 key characters that holds a digit. Both are possessive, so that no text makes them backtrack.
CANDIDATE = rf"{GIVEN}|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{{12,}}+={{0,2}}"
#: Most labelled findings of either class that are learned from.
PER_CLASS = 5000
TREES, DEPTH, SEED = 20, 6, 11
#: Bytes of values that may be sent to every task with their texts' keys.
BROADCAST_BYTES = 16_000_000
#: Characters of context kept on each side.
CONTEXT = 60
#: Words that make a token look written rather than drawn at random.
DICTIONARY = """
about above account action active address admin after again array author basic before begin below between block body button cache call change
char check class client close code color comment common config content copy count country create current data date default delete demo design
detail device display document dummy edit element email empty enter error event example false field file filter final first float folder form
format from function general get global group handle header height hello help home host html http image import index info input insert item
json label large last layout left length level library light line link list load local login long main manager message method mode model module
month name network next none normal null number object open option order output page panel parent password path payment phone photo place
placeholder player point post price private product profile project public query random read remove report request response result return right
""".split()
# Formats of well-known providers; fixed values.
FORMATS = r"^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})$"
CREDENTIAL = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)"
DIGEST = r"(?i)(sha-?[0-9]{1,3}|md5|commit|checksum|digest|hash|uuid|guid|revision|etag|build|version)"
STANDIN = r"(?i)(example|sample|dummy|test|placeholder|changeme|xxxx|1234567|abcdef|your)"
ASSIGNED = r"[:=]\s{0,2}[\"']?$"
DIRECT = rf"{_TO}[\"'`]?$"
# What is written in the place of a value: placeholders, calls, members and names of types.
REFERENCE = r"^(\$\{.*|\$[A-Za-z_]+|\{\{.*|<.*>?|%\(?\w*\)?s?|[*.x•]+|[A-Za-z_][\w.]*(\(.*\)?|\[.*)[,;]?|[A-Za-z_]\w*(\.[A-Za-z_]\w*)+[,;()]*|(?i:none|null|nil|true|false|undefined|string|boolean|integer|optional|required|bearer|basic|digest)[,;]?)$"
#: Values after credential words that every forest of the default labels learns from: before, value, after, label.
EXAMPLES = [
    *[(f'{w} = "', v, '"\n', 1.0) for w, v in [
        ("password", "purpleMonkeyDishwasher"), ("pwd", "blueGuitarMountain"), ("passwd", "sunflower"), ("password", "Gr33n&Apple"), ("secret", "OpenSesameNow"), ("db_password", "k9$Lm2@x"),
        ("password", "Winter#2024"), ("passphrase", "my dog has fleas"), ("pwd", "qwertyuiop"), ("password", "P@ssw0rd!"), ("token", "Zx7.Yq!pLm"), ("password", "iloveyou"), ("secret", "hush.hush!"), ("password", "7Trees+1Lake"),
    ]],
    *[(f"{w}{s}", v, "\n", 1.0) for w, s, v in [
        ("password", ": ", "n0t-So.Easy!"), ("DB_PASSWORD", "=", "Gr33n&Apple"), ("pwd", "=", "letmein!"), ("password", "=", "Zebra$Cross1"), ("PASSWORD", "=", "OpenSesameNow"), ("secret", ": ", "m4ng0#tree"), ("password", "=", "dragon99"), ("token", "=", "q8.Rt!x2"),
    ]],
    *[(f"{w} = ", v, a, 0.0) for w, v, a in [
        ("password", "userPassword", "\n"), ("password", "getpass.getpass()", "\n"), ("token", "process.env.TOKEN", "\n"), ("password", "self.password", "\n"), ("password", "os.environ[", '"DB"'), ("secret", "config.get(", '"secret"'),
        ("password", "${DB_PASSWORD}", "\n"), ("token", "undefined", "\n"), ("auth", "Optional[str]", "\n"), ("token", "nextToken", "\n"), ("password", "********", "\n"), ("pwd", "currentDirectory", "\n"), ("token", "args.token,", "\n"), ("secret", "<secret>", "\n"),
    ]],
    *[(f"the {w}: ", v, a, 0.0) for w, v, a in [
        ("password", "whatever", " you"), ("token", "string", "\n"), ("secret", "nobody", " knows"), ("password", "required", " field"), ("authorization", "Bearer", " x"), ("token", "expired", " today"), ("secret", "practice", " every day"), ("token", "boolean", "\n"),
    ]],
    *[(f'"{w}": "', v, '",', 0.0) for w, v in [
        ("token", "access_token"), ("token", "csrf_token"), ("password", "<password>"), ("password", "{{ password }}"), ("password", "Enter a password"), ("password", "Password is required"), ("secret", "${SECRET}"), ("password", "********"), ("token", "refresh_token"),
    ]],
]
#: Times each example counts.
TIMES = 5


def candidates(documents: DataFrame, keep: Sequence[str] = ("doc_id",), path: str = "source") -> DataFrame:
    """One row per candidate: ``keep``, path, start (character offset), value, before and after (context)."""
    keep = [c for c in dict.fromkeys(keep) if c not in ("path", "start", "value", "before", "after")]
    rows = documents.select(*keep, F.col(path).cast("string").alias("path") if path in documents.columns else F.lit(None).cast("string").alias("path"), F.col("text").alias("_text"))
    rows = rows.where(F.col("_text").rlike("[0-9:=]")).withColumn("_found", F.regexp_extract_all("_text", F.lit(CANDIDATE), 0)).where(F.size("_found") > 0)
    rows = rows.withColumn("_between", F.split("_text", CANDIDATE, -1))
    steps = F.zip_with("_between", "_found", lambda b, v: F.coalesce(F.length(b), F.lit(0)) + F.coalesce(F.length(v), F.lit(0)))
    parts = F.transform(
        "_found",
        lambda v, i: F.struct(
            (F.aggregate(F.slice("_steps", F.lit(1), i), F.lit(0), lambda a, s: a + s) + F.length(F.get("_between", i))).alias("start"),
            v.alias("value"),
            F.right(F.get("_between", i), F.lit(CONTEXT)).alias("before"),
            F.left(F.get("_between", i + 1), F.lit(CONTEXT)).alias("after"),
        ),
    )
    return rows.withColumn("_steps", steps).select(*keep, "path", F.explode(parts).alias("_p")).select(*keep, "path", "_p.*")


def _share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.length("value")


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def features() -> dict[str, Column]:
    """Features of a candidate, by name."""
    value, before, path = F.col("value"), F.coalesce("before", F.lit("")), F.coalesce("path", F.lit(""))
    words = F.transform(F.regexp_extract_all("value", F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), 0), lambda w: F.lower(w))
    covered = F.aggregate(words, F.lit(0), lambda n, w: n + F.when(w.isin(DICTIONARY), F.length(w)).otherwise(0))
    chars = F.split("value", "")
    last = F.regexp_extract(before, r"([\p{L}\p{N}_-]+)[^\p{L}\p{N}]*$", 1)
    return {
        "length": F.length(value).cast("double"),
        "digits": _share("[0-9]"),
        "upper": _share("[A-Z]"),
        "signs": _share("[+/_=-]"),
        "others": _share("[^A-Za-z0-9+/_=-]"),
        "spaces": _share(r"\s"),
        "hex": _share("[0-9a-fA-F]"),
        "distinct": F.size(F.array_distinct(chars)) / F.length(value),
        # Transitions between neighbouring characters.
        "letter_digit": _share("(?<=[A-Za-z])(?=[0-9])"),
        "digit_letter": _share("(?<=[0-9])(?=[A-Za-z])"),
        "case": _share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "vowel": _share("(?i)(?<=[aeiouy])(?=[bcdfghjklmnpqrstvwxz])"),
        "repeat": _share(r"(.)(?=\1)"),
        "covered": covered / F.length(value),
        # Path.
        "test_path": _flag(F.lower(path).rlike("test|spec|example|sample|fixture|mock|doc")),
        "config_path": _flag(F.lower(path).rlike(r"\.env|\.ya?ml|\.json|\.ini|\.conf|\.properties|config|secret")),
        "depth": F.regexp_count(path, F.lit("/")).cast("double"),
        # Words around it.
        "assigned": _flag(before.rlike(ASSIGNED)),
        "direct": _flag(before.rlike(DIRECT)),
        "reference": _flag(value.rlike(REFERENCE)),
        "credential": _flag(last.rlike(CREDENTIAL)),
        "credential_near": _flag(F.right(before, F.lit(30)).rlike(CREDENTIAL)),
        "digest": _flag(F.right(before, F.lit(30)).rlike(DIGEST)),
        "quoted": _flag(F.left("after", F.lit(1)).rlike("[\"']")),
    }


def known_labels() -> Column:
    """1, 0 or null: labels of findings that need no judgement, from their format and assignment.

    Secret: a provider's format, or a drawn-looking value assigned to a credential, or one directly assigned that mixes
    three kinds of characters. Not: digits only (unless directly assigned), stand-ins, references, and what is named a
    digest. The default labeller where no table of labelled findings is given.
    """
    value, before = F.col("value"), F.coalesce("before", F.lit(""))
    drawn = (F.regexp_count("value", F.lit("[0-9]")) >= 3) & (F.size(F.array_distinct(F.split("value", ""))) >= 8) & ~value.rlike("^[0-9]+$")
    assigned = before.rlike(ASSIGNED) & F.right(before, F.lit(24)).rlike(CREDENTIAL)
    direct = before.rlike(DIRECT)
    kinds = sum((value.rlike(k).cast("int") for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0))
    mixed = direct & (kinds >= 3) & ~value.rlike(r"\s")
    digits = value.rlike("^[0-9]+$")
    not_secret = (digits & ~direct) | value.rlike(STANDIN) | (direct & value.rlike(REFERENCE)) | F.right(before, F.lit(24)).rlike(DIGEST)
    return F.when(not_secret, F.lit(0.0)).when(value.rlike(FORMATS) | (assigned & drawn) | mixed, F.lit(1.0))


def fit(labelled: DataFrame, per_class: int = PER_CLASS, examples: DataFrame | None = None):
    """Forest from findings with path, value, before, after and label (0 or 1; others are not used).

    At most about ``per_class`` findings of each class, drawn by hash, are learned from, and all ``examples``. None if
    there are no examples and a class is missing.
    """
    rows = labelled.where(F.col("label").isin(0.0, 1.0) & F.col("value").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2 and examples is None:
        return None
    cells = 1_000_000
    share = F.lit(0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, F.lit(min(cells, -(-cells * per_class // n)))).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64("value", "before", "path"), F.lit(cells)) < share).select("path", "value", "before", "after", "label")
    if examples is not None:
        drawn = drawn.unionByName(examples)
    names = features()
    # The sample is bounded: one ordered partition makes the forest the same on every run.
    sample = written(drawn.select(F.col("label").cast("double").alias("label"), *[c.cast("double").alias(f"f_{n}") for n, c in names.items()]).repartition(1).sortWithinPartitions("label", *[f"f_{n}" for n in names]), "findings")
    assembler = VectorAssembler(inputCols=[f"f_{n}" for n in names], outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction", cacheNodeIds=False)
    return forest.fit(assembler.transform(sample).select("features", "label"))


def fit_by_default(found: DataFrame):
    """Forest from the candidates that ``known_labels`` labels, and ``EXAMPLES``."""
    rows = [(None, value, before, after, label) for before, value, after, label in EXAMPLES for _ in range(TIMES)]
    examples = local_table(found.sparkSession, rows, "path string, value string, before string, after string, label double")
    return fit(found.withColumn("label", known_labels()), examples=examples)


def classify(found: DataFrame, forest) -> DataFrame:
    """Add ``score`` and ``secret`` (score of at least one half) to candidates. Without a forest, known labels decide."""
    if forest is None:
        score = F.coalesce(known_labels(), F.lit(0.5))
        return found.withColumn("score", score).withColumn("secret", F.col("score") >= 0.5)
    names = features()
    given = found.columns
    rows = found.select("*", *[c.cast("double").alias(f"f_{n}") for n, c in names.items()])
    rows = VectorAssembler(inputCols=[f"f_{n}" for n in names], outputCol="features").transform(rows)
    scored = forest.transform(rows).withColumn("score", vector_to_array("_probability")[1])
    return scored.select(*[c for c in given if c != "score"], "score", (F.col("score") >= 0.5).alias("secret"))


def scan(documents: DataFrame, keep: Sequence[str] = ("doc_id",), labelled: DataFrame | None = None, path: str = "source") -> DataFrame:
    """Findings of whole texts: ``keep``, path, start, value, before, after, score and secret.

    ``labelled`` holds labelled findings (path, value, before, after, label); by default the candidates themselves with
    ``known_labels``, with some fixed examples. Null and empty texts have no candidates. Kept columns named like a result are replaced.
    """
    found = written(candidates(documents, keep, path), "candidates")
    return classify(found, fit_by_default(found) if labelled is None else fit(labelled))


def redact(documents: DataFrame, mark: str = "[SECRET]", path: str = "source") -> DataFrame:
    """``documents`` with every secret found in its text replaced by ``mark``; the same columns, n_chars renewed if any.

    Whole values are replaced, the same value everywhere in the corpus. Rows, null texts and all other columns stay.
    """
    columns = documents.columns
    # By the text: equal texts hold equal values, so what is collected for a key is bounded by one text. The row is packed,
    # so that no column clashes with a name used here.
    key = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("_key")
    given = documents.select(key, "text", *([path] if path in columns and path not in ("text", "_key") else []))
    found = written(candidates(given, ("_key",), path), "candidates")
    secret = written(classify(found, fit_by_default(found)).where("secret").select("value").distinct(), "secrets")
    held = found.join(secret, "value", "left_semi").groupBy("_key").agg(F.collect_set("value").alias("_values"))
    held = written(held, "held")
    # Counted and measured: few enough go to every task, so that texts stay where they are.
    n, size = held.agg(F.count("*"), F.coalesce(F.sum(F.aggregate("_values", F.lit(0).cast("long"), lambda a, v: a + F.octet_length(v))), F.lit(0))).first()
    held = F.broadcast(held) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else held
    joined = documents.select(F.struct(*columns).alias("_row"), key).join(held, "_key", "left")
    # Longest first, so that a value inside another one does not break it.
    ordered = F.array_sort("_values", lambda a, b: F.length(b) - F.length(a))
    clean = F.aggregate(ordered, F.col("_row.text"), lambda t, v: F.replace(t, v, F.lit(mark)))
    row = F.col("_row").withField("text", clean)
    if "n_chars" in columns:
        row = row.withField("n_chars", F.length(clean).cast(dict(documents.dtypes)["n_chars"]))
    return joined.select(F.when(F.col("_values").isNull(), F.col("_row")).otherwise(row).alias("_row")).select("_row.*")
