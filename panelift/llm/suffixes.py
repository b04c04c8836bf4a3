"""Suffix-array dedup: bytes covered by a long string that also starts earlier are removed.

Suffixes are dealt into buckets by the least k-gram of their first LENGTH bytes, so that neighbouring
suffixes mostly fall into one bucket and a bucket needs only short stretches of text. Only suffixes whose
least k-gram occurs twice or more enter a bucket. Each bucket is sorted by itself: by its first PERIOD
bytes, and ties by precomputed ranks of a difference-cover sample, so that no comparison runs along a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelift.llm.catalog import query, table
from panelift.llm.text import prefix_sums, slices, span_hash

LENGTH = 100
GRAM = 24
SORT_BYTES = 1 << 21
#: Perfect difference cover: every residue modulo PERIOD is a difference of two members.
COVER, PERIOD = (1, 5, 11, 24, 25, 27), 31
_SHIFT = np.array([min(d for d in range(PERIOD) if (r + d) % PERIOD in COVER) for r in range(PERIOD)])
_PLACES = (1 << 20) - 1


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, first suffix, suffixes, least k-gram) of each run of suffixes that share the place of their least k-gram.

    A suffix counts if its first ``length`` bytes lie within its text. Equal strings of ``length`` bytes
    have the same least k-gram at the same place (the leftmost among equals).
    """
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    gram = min(GRAM, length)
    width = length - gram + 1
    at = np.arange(len(data) - gram + 1)
    hashes = span_hash(prefix_sums(data), at, at + gram)
    low = (hashes & ~np.uint64(_PLACES)) | at.astype(np.uint64)
    size = 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if width > size:
        low = np.minimum(low[: n], low[width - size : width - size + n])
    place = (low & np.uint64(_PLACES)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = np.arange(n) + length <= offsets[1:][text]
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    first = np.flatnonzero(inside & new)
    ends = np.flatnonzero(np.append((new | ~inside)[1:], True) & inside) + 1
    return text[first], first, ends - first, hashes[place[first]]


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each text, bytes, offsets, offset in its row): slices; long texts are cut with an overlap."""
    most = 1 << 19
    for row, data, offsets in slices(column, most):
        if len(data) <= most:
            yield np.arange(row, row + len(offsets) - 1), data, offsets, np.zeros(len(offsets) - 1, np.int64)
        else:
            for low in range(0, max(1, len(data) - length + 1), most):
                part = data[low : low + most + length - 1]
                yield np.array([row]), part, np.array([0, len(part)]), np.array([low])


def _all_segments(column: pa.Array, length: int) -> pd.DataFrame:
    """row, start, count, gram of every segment of a batch."""
    out = []
    for rows, data, offsets, moved in _pieces(column, length):
        text, first, count, gram = segments(data, offsets, length)
        out.append(pd.DataFrame({"row": rows[text], "start": first - offsets[:-1][text] + moved[text], "count": count, "gram": gram}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"row": [], "start": [], "count": [], "gram": np.zeros(0, np.uint64)})


def _packed(keys: np.ndarray, rows: np.ndarray, values: np.ndarray, name: str) -> pa.RecordBatch:
    """One row per key of ``rows`` with its values as bytes."""
    order = np.argsort(rows, kind="stable")
    rows, values = rows[order], values[order]
    cut = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, int)
    parts = [x.tobytes() for x in np.split(values, cut[1:])] if len(cut) else []
    return pa.RecordBatch.from_arrays([pa.array(list(keys[rows[cut]]), pa.binary()), pa.array(parts, pa.binary())], names=["key", name])


def _gram_batches(buckets: int, length: int):
    """Per batch of texts and bucket: the k-grams, each once, and the text that holds it; those met twice in the
    batch go out as known to be repeated, with their texts named at once (no rows; any bucket passes them on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "grams", "rows", "keys"]
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.array(batch.column("key").to_pylist(), object)
            found = _all_segments(batch.column("text"), length)
            grams, inverse, times = np.unique(found.gram.to_numpy(), return_inverse=True, return_counts=True)
            if not len(grams):
                continue
            holder = np.zeros(len(grams), np.int32)
            holder[inverse] = found.row.to_numpy(np.int32)
            holder[times > 1] = -1
            bucket = (grams % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
            columns: list[list] = [[], [], [], []]
            for part in np.split(order, cut[1:]):
                held, place = np.unique(holder[part], return_inverse=True)
                columns[0].append(int(bucket[part[0]]))
                columns[1].append(grams[part].tobytes())
                columns[2].append(np.where(holder[part] < 0, -1, place - int(held[0] < 0)).astype(np.int32).tobytes())
                columns[3].append(b"".join(keys[held[held >= 0]]))
            again = times[inverse] > 1
            rows = found.row.to_numpy(np.int64)[again]
            for key, value in zip(*_packed(keys, rows, found.gram.to_numpy()[again], "grams").to_pydict().values()):
                columns[0].append(key[0] % buckets)
                columns[1].append(value)
                columns[2].append(b"")
                columns[3].append(key)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(x, pa.binary()) for x in columns[1:])], names=names)

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Of one bucket: (key, grams) of the texts whose k-gram another batch holds too, or is known to be repeated."""
    grams, rows, keys, named = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [], []
    for g, r, k in zip(*(table.column(c).to_pylist() for c in ("grams", "rows", "keys"))):
        if not r:
            named.append((k, g))
            continue
        grams.append(np.frombuffer(g, np.uint64))
        r = np.frombuffer(r, np.int32)
        rows.append(np.where(r < 0, -1, r + len(keys)))
        keys += [k[i : i + 16] for i in range(0, len(k), 16)]
    grams, rows = np.concatenate(grams), np.concatenate(rows)
    _, inverse, times = np.unique(grams, return_inverse=True, return_counts=True)
    known = np.zeros(len(times), bool)
    known[inverse[rows < 0]] = True
    keep = (rows >= 0) & ((times > 1) | known)[inverse]
    found = _packed(np.array([*keys, b""], object), rows[keep], grams[keep], "grams")
    return pa.concat_tables([pa.Table.from_batches([found]), _named(named, "grams")])


def _named(pairs: list[tuple[bytes, bytes]], name: str) -> pa.Table:
    keys, values = zip(*pairs) if pairs else ((), ())
    return pa.table({"key": pa.array(keys, pa.binary()), name: pa.array(values, pa.binary())})


def _order(ids: list, keys: list) -> np.ndarray:
    """The rank of each text: by id, nulls last, then by key."""
    rank = np.zeros(len(keys), np.int64)
    known = [i for i, x in enumerate(ids) if x is not None]
    turn = sorted(known, key=lambda i: (ids[i], keys[i])) + sorted(set(range(len(ids))) - set(known), key=lambda i: keys[i])
    rank[np.array(turn, np.int64)] = np.arange(len(turn))
    return rank


def _dense(x: np.ndarray) -> np.ndarray:
    """Ranks without gaps."""
    order = np.argsort(x)
    x = x[order]
    rank = np.zeros(len(x), np.uint64)
    rank[order] = np.cumsum(np.append(False, x[1:] != x[:-1])).astype(np.uint64)
    return rank


def sorted_suffixes(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The order of the suffixes at ``starts`` by at least their first 4 * PERIOD bytes, for suffixes of one residue each.

    Ranks of PERIOD-byte strings come from 8-byte words by doubling. Sample suffixes (places whose
    residue is in COVER) are ranked by doubling along their own places, which stay in the sample. A suffix is
    then placed by its first PERIOD bytes and, among equals, by the rank of the sample suffix that its
    residue names: ties never need more than that one look. Only suffixes of equal residue are ordered
    by text; the caller lays text out so that equal strings have equal residues.
    """
    padded = np.concatenate([text, np.zeros(6 * PERIOD, np.uint8)])
    n = len(text) + 4 * PERIOD
    word = np.zeros(n + 31, np.uint64)
    for k in range(8):
        word |= padded[k : k + len(word)].astype(np.uint64) << np.uint64(56 - 8 * k)
    rank = _dense(word)
    for step, left in ((8, n + 23), (15, n)):
        top = rank.max() + np.uint64(1)
        rank = _dense(rank[:left] * top + rank[step : step + left])
    sample = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    cover = np.zeros(n + 2 * PERIOD, np.uint64)
    cover[sample] = rank[sample] + np.uint64(1)
    for step in (PERIOD, 2 * PERIOD):
        top = cover.max() + np.uint64(1)
        ranked = _dense(cover[sample] * top + cover[np.minimum(sample + step, len(cover) - 1)])
        cover[sample] = ranked + np.uint64(1)
    tie = cover[starts + _SHIFT[starts % PERIOD]]
    return np.lexsort((tie, rank[starts], starts % PERIOD))


def _later(texts: list[bytes], places: np.ndarray, counts: np.ndarray, rank: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment (its first ``counts`` suffixes): which of them also start in a segment of lower rank,
    or earlier in the same text.

    ``places``: where the shared k-gram stands in each segment; ``rank``: order of (text, start).
    """
    at, layout = 0, []
    for t, place in zip(texts, places.tolist()):  # the shared k-gram stands at residue 0 everywhere
        at += -(at + place) % PERIOD
        layout.append(at)
        at += len(t)
    text = np.zeros(at, np.uint8)
    for t, low in zip(texts, layout):
        text[low : low + len(t)] = np.frombuffer(t, np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    begin = np.cumsum(np.append(0, counts[:-1]))
    starts = np.array(layout)[owner] + np.arange(len(owner)) - begin[owner]
    order = sorted_suffixes(text, starts)
    padded = np.concatenate([text, np.zeros(length, np.uint8)])
    same = np.zeros(len(order), bool)
    step = 1 << 16
    for low in range(1, len(order), step):
        a, b = starts[order[low - 1 : low + step - 1]], starts[order[low : low + step]]
        a = a[: len(b)]
        equal = a % PERIOD == b % PERIOD
        for k in range(0, length, 20):
            left = np.flatnonzero(equal)
            cols = np.arange(k, min(length, k + 20))
            equal[left] = (padded[a[left, None] + cols] == padded[b[left, None] + cols]).all(1)
        same[low : low + step] = equal
    group = np.zeros(len(order), np.int64)
    group[order] = np.cumsum(~same)
    position = rank[owner] * (counts.max() + 1) + np.arange(len(owner)) - begin[owner]
    best = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(best, group, position)
    return np.split(position > best[group], begin[1:])


HEAD = np.dtype([("gram", "<u8"), ("row", "<i4"), ("start", "<i4"), ("count", "<i4")])


def _segment_batches(buckets: int, length: int):
    """Per batch and bucket: the segments with repeated k-grams and their bytes; of segments alike in a batch only the
    earliest goes to the bucket, the others are removed at once (no bytes; any bucket passes them on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.array(batch.column("key").to_pylist(), object)
            ids = batch.column("first_id").to_pylist()
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            found = _all_segments(batch.column("text"), length)
            known = [np.frombuffer(b"".join(x), np.uint64) for x in batch.column("grams").to_pylist()]
            sizes = [len(x) for x in known]
            pairs = pd.DataFrame({"row": np.repeat(np.arange(len(known)), sizes), "gram": np.concatenate(known)}).drop_duplicates()
            found = found.merge(pairs, on=["row", "gram"])
            found["order"] = _order(ids, list(keys))[found.row.to_numpy(np.int64)]
            found = found.sort_values(["order", "start"], kind="stable")
            found["bytes"] = [texts[r][s : s + c + length - 1] for r, s, c in zip(found.row, found.start, found["count"])]
            late = found.duplicated("bytes").to_numpy()
            out: list[list] = [[], [], [], [], []]
            spans = np.zeros(late.sum(), "<i4,<i4")
            spans["f0"], spans["f1"] = found.start[late], found.start[late] + found["count"][late]
            for key, value in zip(*_packed(keys, found.row.to_numpy(np.int64)[late], spans, "x").to_pydict().values()):
                for column, v in zip(out, (key[0] % buckets, value, b"", key, [])):
                    column.append(v)
            found = found[~late]
            bucket = (found.gram.to_numpy() % np.uint64(buckets)).astype(np.int64)
            turn = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.append(True, np.diff(bucket[turn]) != 0)) if len(turn) else np.zeros(0, int)
            for part in np.split(turn, cut[1:]) if len(turn) else []:
                some = found.iloc[part]
                held, place = np.unique(some.row.to_numpy(np.int64), return_inverse=True)
                head = np.zeros(len(some), HEAD)
                head["gram"], head["row"], head["start"], head["count"] = some.gram, place, some.start, some["count"]
                for column, v in zip(out, (int(bucket[part[0]]), head.tobytes(), b"".join(some.bytes), b"".join(keys[held]), [ids[r] for r in held])):
                    column.append(v)
            kind = batch.schema.field("first_id").type
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:4]), pa.array(out[4], pa.list_(kind))],
                names=["bucket", "heads", "bytes", "keys", "ids"],
            )

    return run


def _bucket_spans(table: pa.Table, length: int) -> pa.Table:
    """Sort one bucket's suffixes; (key, spans) of those that start earlier elsewhere."""
    texts, heads, keys, ids, named = [], [np.zeros(0, HEAD)], [], [], []
    for h, b, k, i in zip(*(table.column(c).to_pylist() for c in ("heads", "bytes", "keys", "ids"))):
        if not b:
            named.append((k, h))
            continue
        head = np.frombuffer(h, HEAD).copy()
        ends = np.cumsum(head["count"] + length - 1)
        texts += [b[x - n : x] for x, n in zip(ends.tolist(), (head["count"] + length - 1).tolist())]
        head["row"] += len(keys)
        heads.append(head)
        keys += [k[x : x + 16] for x in range(0, len(k), 16)]
        ids += i
    head = np.concatenate(heads)
    turn = np.lexsort((head["start"], _order(ids, keys)[head["row"]])) if len(head) else np.zeros(0, np.int64)
    head, texts = head[turn], [texts[i] for i in turn]
    first, place = {}, np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        place[i] = first.setdefault(t, i)
    rows, low, high = [], [], []
    late = np.flatnonzero(place != np.arange(len(texts)))
    rows.append(head["row"][late])
    low.append(head["start"][late])
    high.append(head["start"][late] + head["count"][late])
    kept = np.flatnonzero(place == np.arange(len(texts)))
    kept = kept[np.argsort(head["gram"][kept], kind="stable")]
    grams = head["gram"][kept]
    alone = np.ones(len(kept), bool)
    if len(kept) > 1:
        equal = grams[1:] == grams[:-1]
        alone[1:] &= ~equal
        alone[:-1] &= ~equal
    # a lone segment can still repeat itself only through another place of its k-gram, which is another segment
    kept, grams = kept[~alone], grams[~alone]
    for part in _chunks(grams, [len(texts[i]) for i in kept]):
        some = np.sort(kept[part])
        own = [texts[i] for i in some]
        places = _gram_places(own, head["gram"][some], min(GRAM, length))
        marks = _later(own, places, head["count"][some].astype(np.int64), np.arange(len(some)), length)
        for i, mark in zip(some, marks):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
            rows.append(np.full(len(edge) // 2, head["row"][i]))
            low.append(head["start"][i] + edge[::2])
            high.append(head["start"][i] + edge[1::2])
    rows = np.concatenate(rows).astype(np.int64)
    spans = np.zeros(len(rows), "<i4,<i4")
    spans["f0"], spans["f1"] = np.concatenate(low), np.concatenate(high)
    found = _packed(np.array([*keys, b""], object), rows, spans, "spans")
    return pa.concat_tables([pa.Table.from_batches([found]), _named(named, "spans")])


def _chunks(grams: np.ndarray, sizes: list[int]) -> Iterator[slice]:
    """Runs of whole k-grams (``grams`` is sorted) of about SORT_BYTES of text: what one sort holds at a time."""
    ends = np.flatnonzero(np.append(grams[1:] != grams[:-1], True)) + 1 if len(grams) else np.zeros(0, int)
    total = np.cumsum(sizes) if len(sizes) else np.zeros(0, int)
    low = 0
    for end, nxt in zip(ends, [*ends[1:], None]):
        if nxt is None or total[nxt - 1] - (total[low - 1] if low else 0) > SORT_BYTES:
            yield slice(low, end)
            low = end


def _gram_places(texts: list[bytes], grams: np.ndarray, gram: int) -> np.ndarray:
    """Where the named k-gram stands (first) in each text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    out = np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20), "right")) - 1)
        part = data[offsets[at] : offsets[end]]
        places = np.arange(len(part) - gram + 1)
        hashes = span_hash(prefix_sums(part), places, places + gram)
        owner = np.repeat(np.arange(at, end), np.diff(offsets[at : end + 1]))[: len(places)]
        hit = np.flatnonzero(hashes == grams[owner])[::-1]
        out[owner[hit]] = hit + offsets[at] - offsets[owner[hit]]
        at = end
    return out


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, packed in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                gone = np.zeros(len(data) + 1, np.int32)
                for part in packed or []:
                    spans = np.frombuffer(part, "<i4,<i4")
                    np.add.at(gone, spans["f0"], 1)
                    np.add.at(gone, spans["f1"] + length - 1, -1)
                mask = np.cumsum(gone[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~mask].tobytes()
                runs = int(np.count_nonzero(np.diff(np.append(0, mask.astype(np.int8))) == 1))
                rows.append((int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()))
            removed, spans, digest = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("first_id"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())],
                names=["key", "first_id", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte of the UTF-8 text (null: empty) is removed if a string of ``length`` bytes covers it that also starts
    earlier: in a document of smaller id, or earlier in the same one. Ids that are alike are told apart by
    their text (smaller MD5 first), null ids come last, and rows alike in id and text are one document.

    Equal texts are folded first (their later copies go whole), so a hot group of copies is one text. All
    texts are shuffled once, by their digest; that exchange serves both passes and the final cut.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # never null, so that no join adds a filter that would keep it from sharing the exchange of texts
    docs = docs.withColumn("key", F.coalesce(F.unhex(F.md5("text")), F.lit(b"")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.min("text").alias("text"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    grams = texts.mapInArrow(_gram_batches(buckets, length), "bucket long, grams binary, rows binary, keys binary")
    named = grams.groupBy("bucket").applyInArrow(_repeated, "key binary, grams binary")
    flagged = named.groupBy("key").agg(F.collect_list("grams").alias("grams"))
    parts = texts.join(flagged, "key").select("key", "first_id", "text", "grams").mapInArrow(
        _segment_batches(buckets, length), f"bucket long, heads binary, bytes binary, keys binary, ids array<{kind}>"
    )
    spans = parts.groupBy("bucket").applyInArrow(lambda t: _bucket_spans(t, length), "key binary, spans binary")
    spans = spans.groupBy("key").agg(F.collect_list("spans").alias("spans"))
    cut = texts.join(spans, "key", "left").select("key", "first_id", "text", "spans").mapInArrow(
        _remove(length), f"key binary, first_id {kind}, n_removed long, n_spans long, kept_sha256 string"
    )
    rows = docs.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes")).join(cut, "key")
    copy = ~F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("n_bytes") >= length)
    return rows.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


@query("op4_suffix_array_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    return remove_repeats(table(spark, folder, "documents"))
