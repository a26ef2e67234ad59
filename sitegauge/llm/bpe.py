"""Byte-pair encoding and decoding by a deterministic automaton over tokens.

The automaton has one state per token (the token read last) and an arc ``s -> t`` labelled ``t`` when ``t`` may follow
``s`` in a correct encoding.  It starts with the base symbols and all arcs between them, and every merge ``(u, v) -> w``
adds one gadget, in order of rank:

* a new state ``w`` that inherits the arcs leaving ``v`` and the arcs entering ``u`` as they stand at that moment,
* without the arc ``u -> v`` from then on, as that pair is always merged,
* and, where ``u = v``, without ``u -> w``, as equal symbols are merged from the left.

Gadgets are stored as they are made (three small tables and the removed arcs), not expanded to all pairs of tokens;
whether an arc exists is read by following the gadgets down.  A word has exactly one path from its first to its last
symbol through such arcs, and that path is its encoding.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from sitegauge.llm.words import bound_batches

# The split pattern of the published vocabulary, and Unicode's white space.
WHITE_SPACE = r"\t-\r \x85\xa0  -     　"
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + WHITE_SPACE + r"\p{L}\p{N}]+"
WORD_END = "</w>"

#: Symbols by which labels are looked up before they are compared in full.
OPENING = 4
SHORT = tuple(range(OPENING - 1, 0, -1))
#: Longest word whose path is found end by end; longer ones are walked without recursion.
SHARED_ENDS = 64
#: Words whose encoding a task remembers, and ends of words; beyond that they are found anew, which changes no result.
MEMORY_WORDS = 200_000
#: Texts whose ids a task gives back together.
TOGETHER = 256


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 stands for itself, the rest follows at 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def packed(token: int) -> bytes:
    """A token as a little-endian unsigned 32-bit integer."""
    return token.to_bytes(4, "little")


@dataclass
class Automaton:
    """Tables of the compiled automaton; small enough to travel with a task (its size is the vocabulary's)."""

    labels: list[str]
    inner: dict[str, int]
    final: dict[str, int]
    openings: dict[str, tuple[int, ...]]
    made: list[int]
    enters_as: list[int]
    leaves_as: list[int]
    removed: dict[int, int]
    special: dict[str, int]
    known_arcs: dict[int, bool] = field(default_factory=dict)
    known_ends: dict[int, dict[str, bytes | None]] = field(default_factory=dict)
    n_ends: int = 0

    def arc(self, s: int, t: int) -> bool:
        """Whether token ``t`` may follow token ``s``."""
        key = s << 20 | t
        known = self.known_arcs.get(key)
        if known is None:
            if len(self.known_arcs) > 2_000_000:
                self.known_arcs.clear()
            known = self.known_arcs[key] = self._follow(s, t)
        return known

    def _follow(self, s: int, t: int, before: int = 1 << 40) -> bool:
        """Whether the arc stands when the gadgets of all ranks under ``before`` are in place."""
        while True:
            if self.removed.get(s << 20 | t, before) < before:
                return False
            made_s, made_t = self.made[s], self.made[t]
            if made_s < 0 and made_t < 0:
                return True
            if made_s == made_t:
                before, s, t = made_s, self.leaves_as[s], self.enters_as[t]
            elif made_s > made_t:
                before, s = made_s, self.leaves_as[s]
            else:
                if s == self.enters_as[t] == self.leaves_as[t]:
                    return False
                before, t = made_t, self.enters_as[t]

    def encode_word(self, word: str) -> bytes:
        """Ids on the only path that spells ``word`` (byte symbols).

        Arcs are tried from the longest label down.  A place that leads nowhere is never tried twice: only one path
        reaches it.  Symbols the vocabulary lacks are left out.
        """
        whole = self.final.get(word)
        if whole is not None:
            return packed(whole)
        if len(word) <= SHARED_ENDS:
            path = self._path(-1, word)
            return self._without_unknown(word) if path is None else path
        inner, final, openings, known_arcs = self.inner, self.final, self.openings, self.known_arcs
        n = len(word)
        path: list[int] = []
        begins, tries = [0], [[*openings.get(word[:OPENING], ()), *SHORT]]
        dead = set()
        at = 0
        while at < n:
            rest = tries[-1]
            token = None
            while rest:
                end = at + rest.pop(0)
                if end > n or end in dead:
                    continue
                token = inner.get(word[at:end]) if end < n else final.get(word[at:])
                if token is None:
                    continue
                if path:
                    follows = known_arcs.get(path[-1] << 20 | token)
                    if not (self.arc(path[-1], token) if follows is None else follows):
                        token = None
                        continue
                break
            if token is not None:
                path.append(token)
                begins.append(end)
                tries.append([*openings.get(word[end : end + OPENING], ()), *SHORT])
                at = end
            elif path:
                dead.add(at)
                begins.pop()
                tries.pop()
                path.pop()
                at = begins[-1]
            else:
                return self._without_unknown(word)
        return b"".join(map(packed, path))

    def _path(self, s: int, rest: str) -> bytes | None:
        """The path from state ``s`` that spells ``rest``; the ends that words share are looked up once."""
        known = self.known_ends.setdefault(s, {})
        if rest in known:
            return known[rest]
        found = None
        n = len(rest)
        token = self.final.get(rest)
        if token is not None and (s < 0 or self.arc(s, token)):
            found = packed(token)
        else:
            for length in (*self.openings.get(rest[:OPENING], ()), *SHORT):
                if length < n:
                    token = self.inner.get(rest[:length])
                    if token is not None and (s < 0 or self.arc(s, token)):
                        end = self._path(token, rest[length:])
                        if end is not None:
                            found = packed(token) + end
                            break
        if s >= 0:
            self.n_ends += 1
            if self.n_ends > MEMORY_WORDS:
                self.known_ends.clear()
                self.n_ends = 0
            known[rest] = found
        return found

    def _without_unknown(self, word: str) -> bytes:
        kept = [c for i, c in enumerate(word) if (c in self.inner if i + 1 < len(word) else c in self.final)]
        return b"" if not kept or len(kept) == len(word) else self.encode_word("".join(kept))

    def decode(self, ids) -> str:
        """Labels of the arcs, a space between them, as the vocabulary names no decoder."""
        return " ".join(map(self.labels.__getitem__, ids))


def compile_automaton(path: str) -> Automaton:
    """Build the automaton from a ``tokenizers`` file, one gadget per merge."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    size = max([*vocabulary.values(), *special.values()]) + 1
    labels = [""] * size
    for text, i in [*vocabulary.items(), *special.items()]:
        labels[i] = text
    made, enters_as, leaves_as = [-1] * size, list(range(size)), list(range(size))
    automaton = Automaton(labels, {}, {}, {}, made, enters_as, leaves_as, {}, special)
    out_of_reach = set()
    for rank, pair in enumerate(merges):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        u, v, w = vocabulary[left], vocabulary[right], vocabulary[left + right]
        if made[w] >= 0:
            raise ValueError(f"two merges make the same token: {labels[w]!r}")
        if u in out_of_reach or v in out_of_reach or not automaton._follow(u, v, rank):
            out_of_reach.add(w)  # the pair never stands side by side, so there is no arc to replace
            continue
        # The gadget: the new state's entering and leaving arcs, and the arc that it replaces.
        made[w], enters_as[w], leaves_as[w] = rank, u, v
        automaton.removed[u << 20 | v] = rank
    lengths: dict[str, set[int]] = {}
    for text, i in vocabulary.items():
        if i in out_of_reach or text in special:
            continue
        ends = text.endswith(WORD_END) and len(text) > len(WORD_END)
        text = text[: -len(WORD_END)] if ends else text
        (automaton.final if ends else automaton.inner)[text] = i
        if len(text) >= OPENING:
            lengths.setdefault(text[:OPENING], set()).add(len(text))
    automaton.openings.update((k, tuple(sorted(v, reverse=True))) for k, v in lengths.items())
    return automaton


class Encoder:
    """Splits whole texts into words and encodes them."""

    def __init__(self, automaton: Automaton):
        import re

        import regex

        self.automaton = automaton
        self.words = regex.compile(SPLIT_PATTERN).findall
        self.special = re.compile("(" + "|".join(map(re.escape, automaton.special)) + ")") if automaton.special else None
        self.symbols = dict(enumerate(byte_symbols()))
        self.memory: dict[str, bytes] = {}

    def ids(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; nothing for a missing text."""
        if not text:
            return b""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return b"".join(
            packed(self.automaton.special[part]) if i % 2 else self._plain(part)
            for i, part in enumerate(self.special.split(text)))

    def _plain(self, text: str) -> bytes:
        words = self.words(unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower())
        memory = self.memory
        for_now = []
        for w in set(words):
            if w not in memory:
                spelled = w.encode("utf-8", "replace").decode("latin-1").translate(self.symbols)
                memory[w] = self.automaton.encode_word(spelled)
                if len(w) > 64 or len(memory) > MEMORY_WORDS:
                    for_now.append(w)
        ids = b"".join(map(memory.__getitem__, words))
        for w in for_now:
            del memory[w]
        return ids


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True,
           digests: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns one row per row: the id column, ``n_tokens`` and, as asked for, ``ids`` and the two digests
    ``ids_sha256`` and ``decoded_sha256``.  A null or empty text has no tokens; a null id stays null; repeated rows
    stay; other columns are left out; an empty table gives an empty result.  The file at ``path`` is read by the
    driver only.
    """
    import pyarrow as pa

    automaton = compile_automaton(path)

    bound_batches(docs.sparkSession)
    names = [id_col, "n_tokens", *["ids"] * keep_ids, *["ids_sha256", "decoded_sha256"] * digests]

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        encoder = Encoder(automaton)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                raws = [encoder.ids(text.as_py()) for text in batch.column(1)]
                sizes = np.array([len(raw) // 4 for raw in raws], np.int64)
                columns = [batch.column(0), pa.array(sizes, pa.int64())]
                if keep_ids:
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raws), np.int32))))
                if digests:
                    columns.append(pa.array([hashlib.sha256(raw).hexdigest() for raw in raws], pa.string()))
                    columns.append(pa.array([hashlib.sha256(automaton.decode(array("I", raw)).encode("utf-8")).hexdigest()
                                             for raw in raws], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint"
    schema += ", ids array<int>" * keep_ids + ", ids_sha256 string, decoded_sha256 string" * digests
    return narrow.mapInArrow(run, schema)


def decode(table: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Text of every list of ids: arc labels joined by a space.  A null list gives a null text, an empty one an empty text."""
    import pyarrow as pa

    automaton = compile_automaton(path)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            texts = [None if ids is None else automaton.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "decoded"])

    schema = f"`{id_col}` {table.schema[id_col].dataType.simpleString()}, decoded string"
    return table.select(F.col(id_col), F.col(ids_col).cast("array<int>").alias("_ids")).mapInArrow(run, schema)
