"""Near duplicates: MinHash signatures joined by multi-index Hamming search.

A document's set holds its distinct runs of `shingle` words; it is signed by
SLOTS minwise hashes of 16 bits. Signatures are split into CHUNKS chunks of
WIDE slots. By the pigeonhole principle, two signatures that differ in at most
DISTANCE = CHUNKS * (ERRORS + 1) - 1 slots have a chunk with at most one wrong
slot. So every chunk is posted once for each slot that may be wrong, the slot
left out: pairs within the distance meet in some bucket for certain. At
similarity 0.8 a pair differs in a fifth of the slots on average; should it
differ in more than DISTANCE, a chunk with at most one error still brings it
together but for a chance near 0.000002. Candidates are confirmed on the full
sets.

Scale: equal sets are one class with one representative from the start. A
bucket's pairs are never all listed. First each representative is compared
with the leaders of two of its buckets, and what links is merged; STAR_ROUNDS
times more, in buckets that still hold several components, with members of
other components. What is left of such buckets is compared in blocks, across
components, each pair in the first bucket it shares. A sketch
of the set's SKETCH smallest hashes, the whole set of a short document, keeps
out pairs that cannot be similar enough (of long documents, but for a chance
below 1e-9 a pair); the others are confirmed. So
no other link between components is lost, and a group of thousands of copies costs a few
comparisons each.

NULL texts and texts without words have an empty set, no links, and are their
own component. A NULL id comes after all others and is told apart by its text;
a component of such rows alone has a NULL id. Rows that repeat an id and text
are kept or dropped together by the query; deduplicate() keeps one of them.
Texts are taken whole, however long. An empty table gives no rows. `near_duplicates` reads only the id and the
text; `deduplicate` keeps all columns in one struct, so their names cannot clash, and takes texts that differ under one
id as documents of their own. An id of 2^62 or more counts as a NULL one in `component_id`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import NO_ID, gram_hashes, hash_words, id_key, mix, narrow, pieces, store, tell_apart
from gridlark.llm.graph import components

BLOCK_BYTES = 4_000_000
SLOTS, CHUNKS, WIDE, ERRORS = 50, 10, 5, 1
#: Slots in which signatures may differ, and still be found for certain.
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Members of a bucket that one task compares with as many others.
BLOCK = 2048
#: Tasks among which the members compared with one leader are dealt.
SALT = 32
#: Smallest hashes of a set in its sketch.
SKETCH = 192
#: Standard errors that a sampled share may fall short.
SLACK = 7
#: Times that components are compared through single members before all of them are.
STAR_ROUNDS = 2

_RNG = np.random.default_rng(20_240_229)
_TIMES = _RNG.integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, SLOTS, dtype=np.uint64)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words, of all words if there are fewer."""
    words = hash_words(text.encode("utf-8", "replace").lower().split()) if text else np.zeros(0, np.uint64)
    return np.unique(gram_hashes(words, min(k, len(words)))) if len(words) else words


def sign(grams: np.ndarray) -> np.ndarray:
    """SLOTS minwise hashes, 16 bits each."""
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(grams), 4096):
        part = grams[low : low + 4096]
        np.minimum(least, (part[None, :] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1), out=least)
    return mix(least).astype("<u2")


def keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each chunk and each slot of it that may be wrong."""
    chunks = signature.reshape(CHUNKS, WIDE).astype(np.uint64)
    place = (np.arange(CHUNKS, dtype=np.uint64)[:, None] * np.uint64(WIDE) + np.arange(WIDE, dtype=np.uint64)[None, :]) + np.uint64(1)
    made = np.empty((CHUNKS, WIDE), np.uint64)
    for wrong in range(WIDE):
        packed = np.zeros(CHUNKS, np.uint64)
        for slot in range(WIDE):
            if slot != wrong:
                packed = (packed << np.uint64(16)) | chunks[:, slot]
        made[:, wrong] = packed
    return mix(made + mix(place)).ravel().astype(np.int64)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return narrow(df, id_col, text_col).select("doc_id", id_key(F.col("doc_id"), F.col("text")).alias("key_id"), "text")


def signatures(df: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key_id, n, set_id (digest of the set), signature; NULL digest and signature of empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in pieces(batches, "text", BLOCK_BYTES):
            sets = [shingles(t, k) for t in block["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [block["doc_id"], block["key_id"], pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 pa.array([sign(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "key_id", "n", "set_id", "signature"],
            )

    return keyed(df, id_col, text_col).mapInArrow(run, "doc_id long, key_id long, n long, set_id binary, signature binary")


def post(reps: DataFrame) -> DataFrame:
    """rep, key: the buckets of each representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [keys(np.frombuffer(s, "<u2")) for s in batch["signature"].to_pylist()]
            if made:
                rep = np.repeat(batch["rep"].to_numpy(), CHUNKS * WIDE)
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(np.concatenate(made))], ["rep", "key"])

    return reps.select("rep", "signature").mapInArrow(run, "rep long, key long")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets share `percent` of their union. sets: rep, grams.

    The members of an `a` are dealt to SALT tasks at most, each of which gets
    the set of `a` once and streams the others.
    """
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALT)).alias("salt"))
    heads = salted.select("a", "salt").distinct().join(sets, F.col("a") == F.col("rep")).select("a", "salt", F.lit(None).cast("long").alias("b"), "grams")
    members = salted.join(sets, F.col("b") == F.col("rep")).select("a", "salt", "b", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            found_a, found_b = [], []
            for a, b, grams in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["grams"]):
                own = np.frombuffer(grams.as_buffer(), np.uint64)
                if b is None:
                    head = own
                    continue
                if min(len(own), len(head)) * 100 < percent * max(len(own), len(head)):
                    continue
                small, large = (own, head) if len(own) < len(head) else (head, own)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                if 100 * both >= percent * (len(own) + len(head) - both):
                    found_a.append(a)
                    found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    # Heads come first: NULL sorts before ids.
    dealt = heads.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "b")
    return dealt.mapInArrow(run, "a long, b long")


def across(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in a bucket whose sets may fit by their sketches.

    mixed: key, rep, component, n, signature, sketch, and members (of the key). A bucket of many members
    is compared block by block, each pair of blocks in a group of its own.
    """
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    blocked = mixed.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("own", own)
    spread = blocked.select(
        "key", "rep", "component", "n", "signature", "sketch", "own",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    ).select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "component", "n", "signature", "sketch")

    def compare(group: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(group)
        rep, comp, n, own = (table[c].to_numpy() for c in ("rep", "component", "n", "own"))
        sig = np.frombuffer(b"".join(table["signature"].to_pylist()), "<u2").reshape(-1, SLOTS)
        low, high = int(table["low"][0].as_py()), int(table["high"][0].as_py())
        bucket = int(np.flatnonzero(keys(sig[0]) == table["key"][0].as_py())[0])
        left = np.flatnonzero(own == low)
        right = np.flatnonzero(own == high)
        sketches = [np.frombuffer(x, np.uint32) for x in table["sketch"].to_pylist()]
        a, b = [], []
        for i in left.tolist():
            js = right[(comp[right] != comp[i])]
            if low == high:
                js = js[js > i]
            js = js[np.minimum(n[js], n[i]) * 100 >= percent * np.maximum(n[js], n[i])]
            if len(js):
                same = sig[js] == sig[i]
                js = js[first_bucket(same) == bucket]
            if len(js):
                js = js[may_fit(sketches[i], n[i], [sketches[j] for j in js.tolist()], n[js], percent)]
                a.append(np.full(len(js), rep[i]))
                b.append(rep[js])
        return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[pa.RecordBatch] = []
        last = None

        def flush() -> pa.RecordBatch:
            a, b = compare(group)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

        for batch in batches:
            where = np.stack([batch[c].to_numpy() for c in ("key", "low", "high")])
            cuts = [0, *(np.flatnonzero((np.diff(where) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                name = tuple(where[:, x].tolist())
                if name != last and group:
                    yield flush()
                    group = []
                group.append(batch.slice(x, y - x))
                last = name
        if group:
            yield flush()

    dealt = spread.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return dealt.mapInArrow(run, "a long, b long")


def may_fit(own: np.ndarray, n_own: int, others: list[np.ndarray], n_others: np.ndarray, percent: int) -> np.ndarray:
    """Which sets can share `percent` of their union with this one, by sketches.

    Compared are all hashes up to the last one that both sketches would hold.
    That is exact for sets within their sketches; else a sample of the union,
    and its share is allowed to fall short by SLACK standard errors: a pair at
    similarity 0.8 falls shorter with a chance below 1e-9.
    """
    flat = np.concatenate(others)
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    ends = np.cumsum(sizes)
    most = np.uint32(0xFFFFFFFF)
    limit = np.where(n_others > SKETCH, flat[ends - 1], most)
    if n_own > SKETCH:
        limit = np.minimum(limit, own[-1])
    inside = flat <= np.repeat(limit, sizes)
    found = inside & (own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat)
    both = np.add.reduceat(found, ends - sizes, dtype=np.int64)
    union = np.searchsorted(own, limit, side="right") + np.add.reduceat(inside, ends - sizes, dtype=np.int64) - both
    share = percent / 100
    slack = np.where((n_others > SKETCH) | (n_own > SKETCH), SLACK * np.sqrt(share * (1 - share) / np.maximum(union, 1)), 0.01)
    return both >= (share - slack) * union


def first_bucket(same: np.ndarray) -> np.ndarray:
    """Number of the first bucket that pairs share, from their equal slots (pairs, SLOTS); all share one."""
    chunks = same.reshape(-1, CHUNKS, WIDE)
    chunk = (chunks.sum(axis=2) >= WIDE - ERRORS).argmax(axis=1)
    slots = chunks[np.arange(len(chunks)), chunk]
    return chunk * WIDE + np.where(slots.all(axis=1), 0, slots.argmin(axis=1))


def edges(stars: DataFrame, *heads: str) -> DataFrame:
    """Distinct pairs (a, b) of a head and the row's rep."""
    return stars.select(F.explode(F.array_distinct(F.array_compact(F.array(*heads)))).alias("a"), F.col("rep").alias("b"))


def mixed_buckets(buckets: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bucket rows with components, and the keys of buckets that hold several, with the lowest."""
    labelled = buckets.join(merged, F.col("rep") == F.col("node"), "left").select("key", "rep", "members", F.coalesce("component", "rep").alias("component"))
    still = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key", "low")
    return labelled, still


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept (the row's key is the component's), key_id of every row."""
    signed = store(signatures(df, k, id_col, text_col), "signatures")
    reps = store(
        signed.where("set_id IS NOT NULL").groupBy("set_id")
        .agg(F.min("key_id").alias("rep"), F.first("n").alias("n"), F.first("signature").alias("signature")),
        "representatives",
    )
    posted = post(reps)
    # rep XOR key is a different order in every bucket, and gives its first member back.
    shared = posted.groupBy("key").agg(
        F.min("rep").alias("leader"), F.min(F.col("rep").bitwiseXOR(F.col("key"))).alias("other"), F.count(F.lit(1)).alias("members")
    ).where("members > 1").withColumn("other", F.col("other").bitwiseXOR(F.col("key")))
    buckets = store(posted.join(shared, "key").select("key", "rep", "leader", "other", "members"), "shared-buckets")
    suspects = store(buckets.select("rep").distinct(), "suspects")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in pieces(batches, "text", BLOCK_BYTES):
            grams = [shingles(t, k) for t in block["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [block["rep"], pa.array([x.tobytes() for x in grams], pa.binary()), pa.array([(x[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes() for x in grams], pa.binary())],
                ["rep", "grams", "sketch"])

    texts = keyed(df, id_col, text_col).select(F.col("key_id").alias("rep"), "text")
    sets = store(texts.join(suspects, "rep", "left_semi").mapInArrow(gather, "rep long, grams binary, sketch binary"), "sets")
    stars = buckets.groupBy("rep").agg(
        F.min(F.when(F.col("leader") != F.col("rep"), F.col("leader"))).alias("x"), F.min(F.when(F.col("other") != F.col("rep"), F.col("other"))).alias("y"))
    links = store(confirm(edges(stars, "x", "y"), sets, percent), "links")
    merged = store(components(links), "merged")
    for number in range(STAR_ROUNDS):
        labelled, still = mixed_buckets(buckets, merged)
        if still.isEmpty():
            break
        heads = labelled.join(still, "key").where("component = low").groupBy("key").agg(F.min("rep").alias("x"), F.max("rep").alias("y"), F.first("low").alias("low"))
        stars = labelled.join(heads, "key").where("component <> low").groupBy("rep").agg(F.min("x").alias("x"), F.max("y").alias("y"))
        links = store(links.unionByName(confirm(edges(stars, "x", "y"), sets, percent)), f"links-{number}")
        merged = store(components(links), f"merged-{number}")
    labelled, still = mixed_buckets(buckets, merged)
    mixed = labelled.join(still, "key").join(reps.select("rep", "n", "signature"), "rep").join(sets.select("rep", "sketch").dropDuplicates(["rep"]), "rep")
    more = store(confirm(store(across(mixed, percent), "candidates"), sets, percent), "more-links")
    final = store(components(links.unionByName(more)), "final")
    by_rep = signed.join(reps.select("set_id", "rep"), "set_id", "left")
    labelled_docs = by_rep.join(final, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep", "key_id")
    return labelled_docs.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(component < NO_ID, component).alias("component_id"), (F.col("key_id") == component).alias("kept"), "key_id",
    )


def deduplicate(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns. Texts that differ under one id are documents of their own."""
    rows = tell_apart(df.select(F.struct(*df.columns).alias("row"), id_key(F.col(id_col), F.col(text_col)).alias("doc"), F.col(text_col).cast("string").alias("text")))
    kept = near_duplicates(rows, k, percent, "doc", "text").where("kept").select(F.col("key_id").alias("doc")).distinct()
    return rows.join(kept, "doc", "left_semi").dropDuplicates(["doc"]).select("row.*")


#: For sets of four-word runs and 80 %.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
e AS (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM d JOIN reach r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""
