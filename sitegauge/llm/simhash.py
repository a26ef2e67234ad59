"""Near copies by SimHash fingerprints, linked through a Gray-order hierarchical index.

Two fingerprints that differ in at most 3 of 64 bits agree on at least one of four 16-bit blocks.  So the distinct
fingerprints are laid out four times, each time rotated to bring another block to the front, and sorted by Gray rank
(the place of a value in the reflected Gray sequence), which keeps values that agree in their leading bits, and then
values that differ in few bits, side by side.  The sorted run is cut into chunks of at most ``CHUNK`` values.  A node
stands for a stretch of a chunk and holds the bits that all its values share (mask and pattern); eight nodes make a
node of the level above.  Two nodes whose shared patterns already differ in more than 3 commonly masked bits are left
with all that hangs under them.

Values with the same leading block are contiguous, so a value's partners are in its own chunk or in chunks that hold
values of the same block: neighbours, or the other chunks of a block that fills many.  Chunk pairs are joined on that
block and their root patterns, and each pair of chunks is one small task-side search.  A search returns a forest that
connects what it linked, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.llm.components import connected
from sitegauge.llm.words import bound_batches, new_name
from sitegauge.operators.skew import salted_join
from sitegauge.session import stage

MAX_BITS = 3
BLOCKS = 4
CHUNK = 2048
FAN = 8


def word_bytes(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8 with A-Z in lower case; bytes.split cuts at the six ASCII spaces."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of a text's shingles; 0 for a text without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = word_bytes(text)
    if not words:
        return 0
    if len(words) < size:
        return xxh64_intdigest(b" ".join(words), 42)
    grams = zip(*[words[i:] for i in range(size)])
    n = len(words) - size + 1
    hashes = np.fromiter((xxh64_intdigest(g, 42) for g in map(b" ".join, grams)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marked: bool = False) -> DataFrame:
    """(id, ``fp`` as a signed 64-bit integer) of every row and, if asked for, ``mark``: a hash of its text."""
    import pyarrow as pa

    bound_batches(docs.sparkSession)
    names = [id_col, *(["mark"] if marked else [])]

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            values = np.array([fingerprint(t.as_py()) for t in batch.column(0)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(values, pa.int64())], names=[*names, "fp"])

    narrow = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col),
                         *([F.xxhash64(text_col).alias("_mark")] if marked else []))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {'mark bigint, ' if marked else ''}fp bigint"
    return narrow.mapInArrow(run, schema)


def rotated(fp: Column, bits: int) -> Column:
    return fp if bits == 0 else F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits))


def gray_rank(value: Column) -> Column:
    """Place of a 64-bit value in the reflected Gray sequence (the running XOR of its bits from the top)."""
    for step in (1, 2, 4, 8, 16, 32):
        value = value.bitwiseXOR(F.shiftrightunsigned(value, step))
    return value


class Index:
    """The nodes over one chunk: level 0 are the values, each further level joins ``FAN`` nodes."""

    def __init__(self, values):
        import numpy as np

        self.patterns, self.masks = [values], [np.full(len(values), ~np.uint64(0))]
        while len(self.patterns[-1]) > 1:
            starts = np.arange(0, len(self.patterns[-1]), FAN)
            every = np.bitwise_and.reduceat(self.patterns[-1], starts)
            some = np.bitwise_or.reduceat(self.patterns[-1], starts)
            mask = np.bitwise_and.reduceat(self.masks[-1], starts) & ~(every ^ some)
            self.patterns.append(every & mask)
            self.masks.append(mask)


def close_pairs(a: Index, b: Index, max_bits: int):
    """Places (i in a, j in b) of all values at most ``max_bits`` apart, in batches; from the roots down."""
    import numpy as np

    same = a is b
    top = max(len(a.patterns), len(b.patterns)) - 1
    todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    offsets = np.arange(FAN)
    while todo:
        level, i, j = todo.pop()
        if len(i) > 65_536:
            half = len(i) // 2
            todo += [(level, i[half:], j[half:]), (level, i[:half], j[:half])]
            continue
        la, lb = min(level, len(a.patterns) - 1), min(level, len(b.patterns) - 1)
        differ = (a.patterns[la][i] ^ b.patterns[lb][j]) & a.masks[la][i] & b.masks[lb][j]
        near = np.bitwise_count(differ) <= max_bits
        i, j = i[near], j[near]
        if level == 0:
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
        elif len(i):
            down_a, down_b = level <= len(a.patterns) - 1, level <= len(b.patterns) - 1
            ia = i[:, None] * FAN + offsets if down_a else i[:, None]
            jb = j[:, None] * FAN + offsets if down_b else j[:, None]
            i = np.repeat(ia, jb.shape[1], axis=1).ravel()
            j = np.tile(jb, (1, ia.shape[1])).ravel()
            fits = (i < len(a.patterns[min(level - 1, len(a.patterns) - 1)])) & (
                j < len(b.patterns[min(level - 1, len(b.patterns) - 1)]))
            if same:
                fits &= i <= j
            todo.append((level - 1, i[fits], j[fits]))


class Forest:
    """Union-find over the places of one or two chunks."""

    def __init__(self, n: int):
        import numpy as np

        self.parent = np.arange(n)

    def add(self, i, j) -> None:
        import numpy as np

        parent = self.parent
        while len(i):
            i, j = parent[i], parent[j]
            apart = i != j
            i, j = i[apart], j[apart]
            low, high = np.minimum(i, j), np.maximum(i, j)
            np.minimum.at(parent, high, low)
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent[:] = up


def links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints, a < b, that connect all fingerprints at most ``max_bits`` apart.

    ``fps`` has one column ``fp`` of distinct values.  The pairs are a forest per searched chunk pair: their transitive
    closure is that of all close pairs.  ``blocks`` must exceed ``max_bits`` and divide 64.
    """
    import pyarrow as pa

    if blocks <= max_bits or 64 % blocks:
        raise ValueError("more blocks than differing bits are needed, and they must divide 64")
    width = 64 // blocks
    laid = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("turn"), gray_rank(rotated(F.col("fp"), width * t)).alias("rank")) for t in range(blocks)
    ])).alias("p")).select("fp", "p.turn", "p.rank")

    def cut(batches: Iterator) -> Iterator:
        import numpy as np

        def node(turn: int, rows: list) -> pa.RecordBatch:
            values = np.concatenate(rows)
            turned = values if turn == 0 else values << np.uint64(width * turn) | values >> np.uint64(64 - width * turn)
            every, some = np.bitwise_and.reduce(values), np.bitwise_or.reduce(values)
            mask = ~(every ^ some)
            first, last = (int(turned[k] >> np.uint64(64 - width)) for k in (0, -1))
            signed = np.array([values[0], every & mask, mask], np.uint64).view(np.int64)
            return pa.RecordBatch.from_pydict({
                "turn": pa.array([turn], pa.int32()), "first_fp": signed[:1], "pattern": signed[1:2], "mask": signed[2:],
                "first": pa.array([first], pa.int64()), "last": pa.array([last], pa.int64()),
                "fps": pa.array([values.view(np.int64)], pa.list_(pa.int64()))})

        turn, held, n = -1, [], 0
        for batch in batches:
            turns = batch.column(1).to_numpy(zero_copy_only=False)
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = 0
            while at < len(values):
                if turns[at] != turn or n == chunk:
                    if n:
                        yield node(turn, held)
                    turn, held, n = int(turns[at]), [], 0
                end = min(at + chunk - n, int(np.searchsorted(turns, turn, side="right")))
                held.append(values[at:end])
                n += end - at
                at = end
        if n:
            yield node(turn, held)

    spark = fps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = stage(
        laid.repartitionByRange(parts, "turn", "rank").sortWithinPartitions("turn", "rank").select("fp", "turn").mapInArrow(
            cut, "turn int, first_fp bigint, pattern bigint, mask bigint, first bigint, last bigint, fps array<bigint>"),
        "gray-chunks")

    roots = chunks.drop("fps").withColumn("block", F.explode(F.array_distinct(F.array("first", "last"))))
    a, b = roots.alias("a"), roots.alias("b")
    differ = F.col("a.pattern").bitwiseXOR(F.col("b.pattern")).bitwiseAND(F.col("a.mask")).bitwiseAND(F.col("b.mask"))
    across = a.join(b, (F.col("a.turn") == F.col("b.turn")) & (F.col("a.block") == F.col("b.block"))
                    & (F.col("a.first_fp") < F.col("b.first_fp")) & (F.bit_count(differ) <= max_bits)).select(
        F.col("a.turn").alias("turn"), F.col("a.first_fp").alias("first_fp"), F.col("b.first_fp").alias("other"))
    left = across.join(chunks.select("turn", "first_fp", F.col("fps").alias("fps_a")), ["turn", "first_fp"])
    pairs = left.join(chunks.select("turn", F.col("first_fp").alias("other"), F.col("fps").alias("fps_b")),
                      ["turn", "other"]).select("fps_a", "fps_b")
    own = chunks.select(F.col("fps").alias("fps_a"), F.lit(None).cast("array<bigint>").alias("fps_b"))

    def search(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            out_a, out_b = [], []
            for one, two in zip(batch.column(0), batch.column(1)):
                x = one.values.to_numpy().view(np.uint64)
                first = Index(x)
                if two.is_valid:
                    y = two.values.to_numpy().view(np.uint64)
                    second, shift, values = Index(y), len(x), np.concatenate([x, y])
                else:
                    second, shift, values = first, 0, x
                forest = Forest(len(values))
                for i, j in close_pairs(first, second, max_bits):
                    forest.add(i, j + shift)
                child = np.flatnonzero(forest.parent != np.arange(len(values)))
                p, q = values[child].view(np.int64), values[forest.parent[child]].view(np.int64)
                out_a.append(np.minimum(p, q))
                out_b.append(np.maximum(p, q))
            if out_a and sum(map(len, out_a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))],
                                                 names=["a", "b"])

    found = own.unionByName(pairs).repartition(parts).mapInArrow(search, "a bigint, b bigint")
    return found.distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(id, ``fingerprint``, ``component_id``) of every row.

    Texts without a word, null ones included, have fingerprint 0, which links like any other.  ``component_id`` is the
    smallest id reachable over links; rows with a null id link too, but the id of a component with no other rows is
    null.  Repeated rows stay.  An empty table gives an empty result.  Other columns are left out.
    """
    marked = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    joined = labelled(marked, id_col, max_bits)
    lows = joined.groupBy("label").agg(F.min("low").alias("component_id"))
    owner = joined.select("fp", "label").join(lows, "label").select("fp", "component_id")
    return salted_join(marked, owner, ["fp"]).select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def labelled(marked: DataFrame, id_col: str, max_bits: int) -> DataFrame:
    """(``fp``, ``low``, ``label``): each fingerprint with its smallest id and its component."""
    groups = stage(marked.groupBy("fp").agg(F.min(id_col).alias("low")), "fingerprint-groups")
    labels = connected(links(groups.select("fp"), max_bits))
    return groups.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows that stay when one row of each group of near copies stays: the one with the smallest id.

    Of several texts with that id the one with the smallest hash stays, so a rerun keeps the same; rows with a null id come
    last.  Texts that are no near copies all stay, also under one id.  All columns stay, whatever their names.
    """
    marked = stage(fingerprints(docs, id_col, text_col, marked=True), "fingerprints")
    owner = labelled(marked, id_col, max_bits).select("fp", "label")
    first = salted_join(marked, owner, ["fp"]).groupBy("label").agg(F.min(F.struct(
        F.col(id_col).isNull().alias("unknown"), F.col(id_col).alias("id"), "mark")).alias("first"))
    keys = [new_name(docs, n) for n in ("key_unknown", "key_id", "key_mark")]

    def keyed(df: DataFrame, id_: Column, mark: Column) -> DataFrame:
        """Rows with keys that are never null, so that join and clearing below need one shuffle and one sort."""
        parts = (id_.isNull(), F.coalesce(id_.cast("string"), F.lit("")), mark)
        return df.withColumns(dict(zip(keys, parts)))

    stays = keyed(first, F.col("first.id"), F.col("first.mark")).select(*keys)
    kept = keyed(docs, F.col(id_col), F.xxhash64(text_col)).join(stays, keys, "left_semi")
    # Rows of one id and text are copies of each other; they lie side by side here.
    return kept.dropDuplicates(keys).select(*docs.columns)
