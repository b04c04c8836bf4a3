"""Personal data: fixed expressions for contact and card data, and person names by weak supervision.

The base kinds (email, ip, card, phone) come from fixed expressions, leftmost and non-overlapping per
kind, with failing matches dropped. Person names are added by weak supervision: candidate spans (two or
three capitalised words) get votes from regex, gazetteer and context labellers; expectation-maximisation
estimates each labeller's reliability and the share of names from the counts of vote patterns over all
candidates of the table; a logistic span classifier is then trained on a bounded sample of candidates
with those estimated labels and decides every candidate.

Work per document is a map: candidates are found and labelled inside tasks, and the only data that
reach the driver are the vote-pattern counts (at most 3**labellers rows) and the classifier's weights.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelift.llm.catalog import query, table
from panelift.session import spill

# Fixed values of the contract: the base kinds, in their order, and their expressions.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Kind of the spans the method adds, ordered after the base kinds.
NAME = "name"
ORDER = {k: i for i, k in enumerate(KINDS + (NAME,))}
#: Candidates used to fit the span classifier (the labels themselves come from all candidates).
TRAIN_ROWS = 50_000
EM_ROUNDS = 50

CANDIDATE = re.compile(r"(?<![A-Za-z])[A-Z][a-z]+(?: [A-Z][a-z]+){1,2}(?![A-Za-z])")
# Own word lists of the labellers.
GIVEN_NAMES = frozenset(
    "james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony "
    "mark donald steven paul andrew joshua kenneth kevin brian george timothy ronald edward jason jeffrey ryan "
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty margaret sandra "
    "ashley kimberly emily donna michelle carol amanda melissa deborah stephanie rebecca sharon laura cynthia "
    "anna maria peter hans ivan olga ahmed fatima mohammed wei li yuki hiroshi carlos juan sofia lucas emma".split()
)
COMMON = frozenset(
    "the this that these those there then when where what which while with without within from into onto "
    "and but for nor yet our your their his her its we you they he she it in on at by of to as an a if "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july "
    "august september october november december new old north south east west general public license".split()
)
PLACES = frozenset("inc ltd corp company group bank university street avenue road city county state river park hotel".split())
TITLE = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof)\.?\s$")
INTRODUCED = re.compile(r"(?i)(?:name is|i am|i'm|contact|signed|regards,?|sincerely,?|dear|by|from|ask)\s$")
SPEAKS = re.compile(r"^(?:,? (?:said|says|wrote|writes|told|asked|replied)\b|, who\b)")
LABELLERS = ("given_name", "title", "introduced", "speaks", "in_email", "common_word", "place_word", "sentence_start")
ABSTAIN = -1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds: leftmost non-overlapping matches per kind, failing ones dropped."""
    out = []
    for kind in KINDS:
        for m in PATTERNS[kind].finditer(text):
            s = m.group()
            digits = sum(c.isdigit() for c in s)
            if kind == "ip" and any(int(p) > 255 for p in s.split(".")):
                continue
            if kind == "card" and not (14 <= digits <= 19 and _luhn(s)):
                continue
            if kind == "phone" and not 10 <= digits <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def _luhn(s: str) -> bool:
    digits = [int(c) for c in s if c.isdigit()][::-1]
    total = sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(digits))
    return total % 10 == 0


def candidates(text: str, emails: list[str]) -> list[tuple[int, int, list[int], list[float]]]:
    """(start, end, votes, features) of each candidate name; a vote is 1 (name), 0 (not) or -1 (abstain)."""
    locals_ = {p for e in emails for p in re.split(r"[._+-]", e.split("@")[0].lower()) if len(p) > 1}
    out = []
    for m in CANDIDATE.finditer(text):
        words = m.group().split(" ")
        lower = [w.lower() for w in words]
        before, after = text[max(0, m.start() - 24) : m.start()], text[m.end() : m.end() + 16]
        at_start = m.start() == 0 or bool(re.search(r"[.!?\n]\s*$", before))
        votes = [
            1 if lower[0] in GIVEN_NAMES else ABSTAIN,
            1 if TITLE.search(before) else ABSTAIN,
            1 if INTRODUCED.search(before) else ABSTAIN,
            1 if SPEAKS.search(after) else ABSTAIN,
            1 if locals_ and all(w in locals_ for w in lower) else ABSTAIN,
            0 if any(w in COMMON for w in lower) else ABSTAIN,
            0 if lower[-1] in PLACES else ABSTAIN,
            0 if at_start and lower[0] not in GIVEN_NAMES else ABSTAIN,
        ]
        features = [float(v == 1) for v in votes] + [float(v == 0) for v in votes]
        features += [len(words) - 2.0, np.mean([len(w) for w in words]) / 10, float(after[:1] in ",.;:"), float(at_start)]
        out.append((m.start(), m.end(), votes, features))
    return out


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = EM_ROUNDS) -> tuple[float, np.ndarray]:
    """(share of names, accuracy of each labeller) by EM over (votes, count) patterns.

    Each labeller that votes is right with its own probability whatever the class (one-coin model);
    labellers are independent given the class. Accuracies start at 0.7 and stay within [0.01, 0.99].
    """
    if not patterns:
        return 0.5, np.full(len(LABELLERS), 0.7)
    votes = np.array([p for p, _ in patterns], float)
    counts = np.array([c for _, c in patterns], float)
    voted = votes != ABSTAIN
    prior, accuracy = 0.5, np.full(votes.shape[1], 0.7)
    for _ in range(rounds):
        posterior = posteriors(votes, prior, accuracy)
        weight = counts[:, None] * voted
        right = posterior[:, None] * (votes == 1) + (1 - posterior[:, None]) * (votes == 0)
        accuracy = np.clip((weight * right).sum(0) / np.maximum(weight.sum(0), 1e-12), 0.01, 0.99)
        accuracy[weight.sum(0) == 0] = 0.7
        prior = float(np.clip((counts * posterior).sum() / counts.sum(), 0.001, 0.999))
    return prior, accuracy


def posteriors(votes: np.ndarray, prior: float, accuracy: np.ndarray) -> np.ndarray:
    """P(name | votes) under the one-coin model."""
    weight = np.log(accuracy / (1 - accuracy))
    odds = np.log(prior / (1 - prior)) + ((votes == 1) * weight).sum(1) - ((votes == 0) * weight).sum(1)
    return 1 / (1 + np.exp(-odds))


def _candidate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            text = text or ""
            emails = [text[s:e] for k, s, e in base_spans(text) if k == "email"]
            rows += [(doc_id, s, e, v, f) for s, e, v, f in candidates(text, emails)]
        columns = list(zip(*rows)) if rows else [[], [], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
             pa.array(columns[3], pa.list_(pa.int32())), pa.array(columns[4], pa.list_(pa.float64()))],
            names=["doc_id", "start", "end", "votes", "features"],
        )


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], ORDER[x[0]], x[2])))


def private_data(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_name.

    Offsets are code points, ends exclusive; a null text is empty. spans lists ``kind:start:end`` of the base
    kinds and of the names the classifier accepts, by start, then kind (email, ip, card, phone, name),
    comma-joined; base_sha256 is the lowercase-hex sha256 of that list for the base kinds alone. Rows stay as
    they are (repeated rows give repeated results, a null id stays null); other columns are not read. Without
    candidates, or when the estimated labels of the sample are all of one class, every candidate gets that
    class's decision (no candidate: no names).
    """
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = spill(rows.mapInArrow(_candidate_batches, "doc_id long, start long, end long, votes array<int>, features array<double>"), "names")
    patterns = [(tuple(r["votes"]), r["n"]) for r in found.groupBy("votes").agg(F.count("*").alias("n")).collect()]
    prior, accuracy = estimate(patterns)
    weights, intercept = _classifier(found, prior, accuracy, train_rows)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in _SCHEMA.names}
            for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                t = t or ""
                base = base_spans(t)
                emails = [t[s:e] for k, s, e in base if k == "email"]
                named = [(NAME, s, e) for s, e, _, f in candidates(t, emails) if float(np.dot(weights, f)) + intercept >= 0]
                out["doc_id"].append(i)
                for kind in KINDS:
                    out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
                out["n_name"].append(len(named))
                out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out["spans"].append(_joined(base + named))
            yield pa.RecordBatch.from_pydict(out, schema=_SCHEMA)

    return rows.mapInArrow(decide, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_name long")


_SCHEMA = pa.schema(
    [("doc_id", pa.int64())] + [(f"n_{k}", pa.int64()) for k in KINDS] + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_name", pa.int64())]
)


def _classifier(found: DataFrame, prior: float, accuracy: np.ndarray, train_rows: int) -> tuple[np.ndarray, float]:
    """Logistic weights over the features, fitted to the EM labels of at most ``train_rows`` candidates.

    The sample is the candidates of smallest hash of (doc_id, start): the same at every run.
    """
    width = 2 * len(LABELLERS) + 4
    weight = np.log(accuracy / (1 - accuracy))
    odds = F.lit(float(np.log(prior / (1 - prior))))
    for j, w in enumerate(weight):
        odds = odds + F.when(F.col("votes")[j] == 1, float(w)).when(F.col("votes")[j] == 0, -float(w)).otherwise(0.0)
    sample = found.orderBy(F.xxhash64("doc_id", "start", "end")).limit(train_rows)
    labelled = sample.select(array_to_vector("features").alias("x"), (odds >= 0).cast("double").alias("y"))
    classes = [r["y"] for r in labelled.select("y").distinct().collect()]
    if len(classes) < 2:
        return np.zeros(width), (1.0 if classes == [1.0] else -1.0)
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=1e-3, maxIter=100).fit(labelled)
    return model.coefficients.toArray(), float(model.intercept)


@query("op12_pii")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every whole document."""
    return private_data(table(spark, folder, "documents"))
