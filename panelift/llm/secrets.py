"""Secret scan: values after telling names and long tokens of code-like characters, and a random forest that drops the harmless ones.

Everything on the main path is DataFrame expressions and Spark ML; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelift.llm.catalog import query, table
from panelift.session import spill

#: Names before an assigned secret, formats that are issued as keys, web tokens, and what stands before a password in an address.
_NAME = r"""(?i:token|secret|passw(?:or)?d|pwd|api_?key|credential|auth)[A-Za-z_]{0,8}["']?\s{0,3}[:=]{1,2}\s{0,3}"""
NAMED = _NAME + """["']?$"""
#: What may be a secret at all: the whole value after a telling name (6 signs or more, up to the quote or a space), the password
#: in scheme://user:password@host, dotted tokens as one, and long runs of code characters. Short looks back come first, for speed.
_QUOTED = "|".join(rf"(?<={q})(?<=[:=]\s{{0,3}}{q})(?<={_NAME}{q})[^{q}\s]{{6,}}+" for q in "\"'")
_BARE = rf"""(?<=[\s:=])(?<=[:=]\s{{0,3}})(?<={_NAME})(?=[^\s"'<>:=][^\s"'<>]{{5}})[^\s"'<>]+(?<![.,;)\]}}])"""
_ADDRESS = r"(?<=:)(?<=://[^\s/@:]{1,64}:)[^\s/]{3,256}(?=@)"
_DOTTED = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]{20,}+"
TOKEN = f"{_QUOTED}|{_BARE}|{_ADDRESS}|{_DOTTED}|[A-Za-z0-9+/_-]{{12,}}={{0,2}}"
WEB = r"^eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$"
USER = r"(^|://)[^\s/@:]+:$"
ISSUED = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abp]-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{35})$"
MASK = "[SECRET]"

BEFORE, AFTER = 48, 24
FEATURES = [
    "length", "changes", "digits", "capitals", "hex_only", "distinct", "coverage", "word_run",
    "slashes", "path_before", "path_after", "assigned", "quoted", "named", "issued_start",
]


def _pieces(text: Column) -> tuple[Column, Column]:
    """(tokens, gaps): the text is gap 0, token 0, gap 1, token 1 ... last gap."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.split(text, TOKEN, -1)


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, place, token, before, after, start): every token, the characters around it and its offset.

    ``text_key`` is a hash of the text, so that repeated ids do not mix. Null texts have no tokens.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    tokens, gaps = _pieces(F.col("text"))
    cut = docs.where(F.col("text").rlike(TOKEN)).select("doc_id", "text_key", tokens.alias("t"), gaps.alias("g"))
    n = F.size("t")
    around = F.arrays_zip(
        F.col("t").alias("token"),
        F.transform(F.slice("g", F.lit(1), n), lambda x: F.substring(x, -BEFORE, BEFORE)).alias("before"),
        F.transform(F.slice("g", F.lit(2), n), lambda x: F.substring(x, 1, AFTER)).alias("after"),
        F.transform(F.slice("g", F.lit(1), n), lambda x: F.length(x)).alias("gap"),
    )
    rows = cut.select("doc_id", "text_key", F.posexplode(around).alias("place", "x")).select("doc_id", "text_key", "place", "x.*")
    rows = rows.distinct()  # rows alike in id and text are one document
    order = Window.partitionBy("doc_id", "text_key").orderBy("place")
    start = F.sum(F.col("gap") + F.length("token")).over(order) - F.length("token")
    return rows.withColumn("start", start).drop("gap")


def common_words(docs: DataFrame, text: str = "text", words: int = 5000) -> DataFrame:
    """(word): the ``words`` words of three or more letters that most documents hold, counted over all documents."""
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]{3,}"), F.lit(0))))
    counted = docs.select(found.alias("word")).groupBy("word").count()
    return counted.orderBy(F.desc("count"), "word").limit(words).select("word")


def with_features(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``found`` with the columns FEATURES; ``dictionary`` (word) is at most a few thousand rows.

    Length; changes of character class; digits, capitals and distinct characters per character; only hexadecimal;
    letters that stand in dictionary words (camel case and signs part words); longest run of letters;
    slashes inside, path or address signs around; assignment, quote, telling name or issued prefix before.
    """
    token, size = F.col("token"), F.length("token").cast("double")
    count = lambda pattern: (F.length(token) - F.length(F.regexp_replace(token, pattern, ""))) / size
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "9")
    parts = F.regexp_extract_all(token, F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0))
    runs = F.transform(F.split(token, "[^A-Za-z]+"), lambda x: F.length(x))
    out = found.withColumns(
        {
            "length": size,
            "changes": F.length(shape) / size,
            "digits": count("[0-9]"),
            "capitals": count("[A-Z]"),
            "hex_only": token.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
            "distinct": F.size(F.array_distinct(F.split(token, ""))) / size,
            "word_run": F.array_max(runs) / size,
            "slashes": count("[^/]") * -1 + 1,
            "path_before": F.col("before").rlike(r"([/\\.@#~]|://[^ ]*)$").cast("double"),
            "path_after": F.col("after").rlike(r"^([/\\@]|\.[A-Za-z0-9])").cast("double"),
            "assigned": F.col("before").rlike(r"""[:=]\s{0,3}["']?$""").cast("double"),
            "quoted": F.col("before").rlike(r"""["']$""").cast("double"),
            "named": F.col("before").rlike(NAMED).cast("double"),
            "issued_start": token.rlike("^(AKIA|gh[pousr]_|xox[abp]-|AIza)").cast("double"),
        }
    )
    words = out.select("token", F.explode(F.array_distinct(parts)).alias("part")).distinct().withColumn("word", F.lower("part"))
    covered = words.join(F.broadcast(dictionary), "word").groupBy("token").agg(F.sum(F.length("part")).alias("_covered"))
    out = out.join(covered, "token", "left")
    return out.withColumn("coverage", F.least(F.lit(1.0), F.coalesce(F.col("_covered") / size, F.lit(0.0)))).drop("_covered")


def _certain() -> Column:
    """Whether token, before and after are a secret by form."""
    token, before, after = F.col("token"), F.col("before"), F.col("after")
    long = (F.length(token) >= 16) & token.rlike("[0-9]")
    short = token.rlike("[0-9]") & token.rlike("[A-Za-z]") & (F.length(token) >= 6)
    value = before.rlike(NAMED) & (long | short) & ~token.rlike(r"[()\[\]{}<>]")
    return token.rlike(ISSUED) | token.rlike(WEB) | value | (before.rlike(USER) & after.rlike("^@"))


def certain_labels(found: DataFrame) -> DataFrame:
    """Labelled findings without a reader: ``label`` 1 for issued formats, web tokens, passwords in addresses and named
    assignments of letters and digits, 0 for plain words, numbers, paths and addresses; what is neither is left out."""
    token, before, after = F.col("token"), F.col("before"), F.col("after")
    key_part = before.rlike(r"[A-Za-z0-9_-]{6,}\.$") & token.rlike("[0-9]") & token.rlike("[A-Z]") & token.rlike("[a-z]")
    login = before.rlike(r"[^\s/@:]+:$") & after.rlike("^@")
    dotted = (before.rlike(r"[@.]$") | after.rlike("^@")) & ~key_part & ~login
    harmless = token.rlike("^([A-Za-z]+|[0-9]+|[a-z]+([_/-][a-z]+)+)$") | before.rlike(r"[/\\]$") | after.rlike("^/") | dotted
    return found.withColumn("label", F.when(_certain(), 1.0).when(harmless, 0.0)).where("label is not null")


def train(labelled: DataFrame, trees: int = 20, depth: int = 6) -> Model | None:
    """A forest from ``labelled`` findings (FEATURES and label), or None without both classes."""
    if labelled.select("label").distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(labelled)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featuresCol="features", labelCol="label").fit(rows)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", labelled: DataFrame | None = None, rows: int = 10000) -> DataFrame:
    """(doc_id, text_key, place, start, length, token, score): tokens that the forest holds for secrets (score >= 0.5).

    ``labelled`` (token, before, after, label 0 or 1) trains the forest; without it, findings that are
    certain by form do: at most ``rows`` distinct ones of each label, those of lowest hash. If they are all of
    one kind there is nothing to learn, and only certain secrets are found. What is certain to be a secret by form is
    found whatever the forest says. All documents are scanned whole
    and all count for the dictionary.
    """
    dictionary = spill(common_words(docs, text), "dictionary")
    found = spill(candidates(docs, doc_id, text), "tokens")
    given = labelled is not None
    if not given:
        known = certain_labels(found).select("token", "before", "after", "label").distinct()
        order = F.xxhash64("token", "before", "after"), F.col("token"), F.col("before"), F.col("after")
        some = [known.where(F.col("label") == k).orderBy(*order).limit(rows) for k in (0.0, 1.0)]
        labelled = some[0].unionByName(some[1])
    sample = spill(with_features(labelled, dictionary).orderBy("token", "before", "after").coalesce(1), "labelled")
    model = train(sample)
    if model is None:
        scored = certain_labels(found).withColumn("score", F.col("label"))
    else:
        rows_in = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(found, dictionary))
        scored = model.transform(rows_in).withColumn("score", vector_to_array("probability")[1])
        if not given:
            scored = scored.withColumn("score", F.when(_certain(), 1.0).otherwise(F.col("score")))
    scored = scored.where("score >= 0.5")
    return scored.select("doc_id", "text_key", "place", "start", F.length("token").alias("length"), "token", "score")


def mask(docs: DataFrame, secrets: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every found secret replaced by MASK; all else stays as it is."""
    by_doc = secrets.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set("place").alias("_places"))
    both = docs.join(by_doc, docs[doc_id].eqNullSafe(by_doc._id) & (F.xxhash64(docs[text]) == by_doc._key), "left")
    tokens, gaps = _pieces(F.col(text))
    shown = F.transform(tokens, lambda x, i: F.when(F.array_contains("_places", i), MASK).otherwise(x))
    rebuilt = F.array_join(F.flatten(F.zip_with(gaps, F.concat(shown, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    return both.withColumn(text, F.when(F.col("_places").isNull(), F.col(text)).otherwise(rebuilt)).select(*docs.columns)


@query("op7_secret_scans")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, length, token and score of every secret."""
    return find(table(spark, folder, "documents")).select("doc_id", "start", "length", "token", "score")
