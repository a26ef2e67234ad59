"""Packing tokenised documents into sequences of fixed length by hierarchical best fit.

A document longer than a sequence is cut from its end into full pieces; what is left of it, and every shorter document, is
an item.  Items are dealt into groups of bounded size, and each group is packed on its own: largest first, each into the
sequence with the least room that still holds it.  Nearly full sequences are done.  The others go up a tree, as items of
the next round, where the groups below one node meet and are packed by best fit again, until a single group is left or
merging makes the groups no fewer.  A sequence carries the numbers of its pieces, at most one per token of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from sitegauge.llm.words import bound_batches, type_of
from sitegauge.session import stage

LENGTH = 1024
END = 2
#: Items packed together, about; it does not grow with the input.
GROUP = 65_536
#: Sequences with at most this share of room are done.
NEARLY_FULL = 1 / 128
#: Words whose ids a task keeps.
KNOWN_WORDS = 500_000

#: Letters and digits that every version of the character tables has, of the commonest scripts, and all that PLAIN adds.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ȟΑ-ΡΣ-ώА-я一-龥ぁ-ゔァ-ヺ가-힣"
DIGITS = "0-9²³¹¼-¾"
SPACES = "\t\n\r "
PLAIN = SPACES + "\x21-\x7e¡-ȟ‐-‧" + LETTERS
# How the byte-level tokenizer parts a text into words, for texts of PLAIN characters.
WORDS = (rf" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{DIGITS}]+| ?[^{SPACES}{LETTERS}{DIGITS}]+"
         rf"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: itself where it can be printed, else the next one from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in printed} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printed)}


def encoder(tokenizer: str):
    """A function from text to its ids, as little-endian unsigned 32-bit integers, by the ``tokenizers`` library.

    ``tokenizer`` is the content of its file.  A text is parted as the library does it and each different word is given to
    the library's model once.  Texts that hold a special token, or characters that the installed tables may class otherwise,
    and all texts of tokenizers that part them in another way, are encoded by the library as a whole.
    """
    import json
    import re
    from array import array

    from tokenizers import Tokenizer

    library = Tokenizer.from_str(tokenizer)
    library.no_truncation()
    library.no_padding()
    told = json.loads(tokenizer)
    parts = told.get("pre_tokenizer") or {}
    by_words = (parts.get("type") == "ByteLevel" and not parts.get("add_prefix_space") and parts.get("use_regex", True)
                and told.get("normalizer") is None)
    words_of, letters, model = re.compile(WORDS).findall, byte_letters(), library.model
    special = [t["content"] for t in told.get("added_tokens") or ()]
    whole = re.compile("|".join([f"[^{PLAIN}]", *map(re.escape, special)])).search

    class Known(dict):
        def __missing__(self, word: str) -> bytes:
            found = model.tokenize(word.encode().decode("latin-1").translate(letters))
            ids = array("I", [token.id for token in found]).tobytes()
            if len(self) < KNOWN_WORDS:
                self[word] = ids
            return ids

    known = Known()

    def ids_of(text: str) -> bytes:
        if not by_words or whole(text):
            return array("I", library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(known.__getitem__, words_of(text)))

    return ids_of


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
           end: int = END, keep_ids: bool = False) -> DataFrame:
    """Staged pieces of all documents: ``number`` (of the piece, unique), ``id``, ``piece``, ``start``, ``length``,
    ``ids_crc32`` and, if asked for, ``ids``.

    A document's ids end with ``end``.  The last pieces are ``length`` long; the first takes the rest.
    """
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        from array import array
        from zlib import crc32

        import numpy as np
        from pyspark import TaskContext

        ids_of = encoder(tokenizer)
        last = array("I", [end]).tobytes()
        number = TaskContext.get().partitionId() << 40
        names = ["number", "id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
        for batch in batches:
            place: list[int] = []
            columns: list[list] = [[] for _ in range(5)]
            held: list = []
            for i, text in enumerate(batch.column(0)):
                ids = ids_of(text.as_py() or "") + last
                n = len(ids) // 4
                cuts = [0, *range(n % length or length, n + 1, length)] if n > length else [0, n]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[4 * a : 4 * b]
                    place.append(i)
                    for column, x in zip(columns, (number, piece, a, b - a, crc32(part))):
                        column.append(x)
                    if keep_ids:
                        held.append(np.frombuffer(part, np.int32))
                    number += 1
            numbers, piece, start, size, crc = columns
            arrays = [pa.array(numbers, pa.int64()), batch.column(1).take(pa.array(place, pa.int32())), pa.array(piece, pa.int32()),
                      pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            if keep_ids:
                arrays.append(pa.array(held, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    schema = f"number bigint, id {type_of(rows, 'id')}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return stage(rows.mapInArrow(run, schema + (", ids array<int>" if keep_ids else "")), "pieces")


def best_fit(sizes, length: int) -> list[list[int]]:
    """Places of the items in each bin: largest first, each into the fullest bin that still holds it.

    Bins are kept by their room, and one integer has a bit for every room that some bin has.
    """
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = length, len(bins)
            bins.append([i])
        if room > size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins


def packed(items: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(``number``, ``sequence_id``, ``offset``) of every item (``number``, ``length``), none longer than ``length``.

    ``sequence_id`` is the number of the sequence's first piece.
    """
    import pyarrow as pa

    room = int(length * NEARLY_FULL)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("first", "ascending")])  # rows come in any order; the packing must not depend on it
        sizes, place = table["size"].to_pylist(), table["place"][0].as_py()
        numbers, lengths = table["numbers"].to_pylist(), table["lengths"].to_pylist()
        out: dict[str, list] = {"place": [], "first": [], "size": [], "numbers": [], "lengths": [], "done": []}
        for members in best_fit(sizes, length):
            size = sum(sizes[i] for i in members)
            n = [x for i in members for x in numbers[i]]
            row = (place, n[0], size, n, [x for i in members for x in lengths[i]], size + room >= length)
            for column, x in zip(out.values(), row):
                column.append(x)
        return pa.table(out, schema=pa.schema([
            ("place", pa.int64()), ("first", pa.int64()), ("size", pa.int64()), ("numbers", pa.list_(pa.int64())),
            ("lengths", pa.list_(pa.int64())), ("done", pa.bool_())]))

    groups = max(1, -(-items.count() // group))
    level = items.select(
        F.pmod(F.xxhash64("number"), F.lit(groups)).alias("place"), F.col("number").alias("first"), F.col("length").alias("size"),
        F.array("number").alias("numbers"), F.array("length").alias("lengths"))
    finished: list[DataFrame] = []
    while True:
        bins = stage(level.groupBy("place").applyInArrow(
            pack, "place bigint, first bigint, size bigint, numbers array<bigint>, lengths array<bigint>, done boolean"), "bins")
        left = bins.where("NOT done")
        fewer = max(1, -(-left.count() // group))
        if groups == 1 or fewer >= groups:
            finished.append(bins)
            break
        finished.append(bins.where("done"))
        # Neighbouring groups meet in one node of the level above.
        level = left.withColumn("place", F.floor(F.col("place") * fewer / groups).cast("long")).drop("done")
        groups = fewer
    ends = F.aggregate("lengths", F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    listed = [b.select("first", F.inline(F.arrays_zip(F.col("numbers").alias("number"), F.slice(
        ends, 1, F.size("numbers")).alias("offset")))) for b in finished]
    every = listed[0]
    for more in listed[1:]:
        every = every.unionByName(more)
    return every.select("number", F.col("first").alias("sequence_id"), "offset")


def place(cut: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; a full piece is a sequence of its own."""
    full = cut.where(F.col("length") == length)
    short = cut.where(F.col("length") < length)
    placed = short.join(packed(short.select("number", "length"), length, group), "number")
    return placed.unionByName(full.withColumn("sequence_id", F.col("number")).withColumn("offset", F.lit(0).cast("long")))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END,
         group: int = GROUP) -> DataFrame:
    """Per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``.

    ``tokenizer`` is the content of a tokenizer file.  A null or empty text has the end's id alone; null ids and repeated rows
    are documents like any other; an empty table gives an empty result.  Other columns are left out.
    """
    placed = place(pieces(docs, tokenizer, id_col, text_col, length, end), length, group)
    columns = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return placed.select(*columns).toDF(id_col, *columns[1:])


def sequences(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
              end: int = END, group: int = GROUP) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``ids``, and per piece its id and place in ``ids`` (``pieces``)."""
    placed = place(pieces(docs, tokenizer, id_col, text_col, length, end, keep_ids=True), length, group)
    # A group is one sequence, so it holds at most ``length`` ids.
    return placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "id", "piece", "ids"))).alias(
        "all")).select("sequence_id", F.flatten(F.col("all.ids")).alias("ids"),
                       F.transform("all", lambda p: p.dropFields("ids")).alias("pieces"))
