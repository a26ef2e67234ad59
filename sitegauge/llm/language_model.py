"""Language-model scores of whole documents by a gated recurrent network in numpy.

The network reads words and predicts the next one through a class-factored softmax: first the word's class, then the
word within it.  The most frequent training words form the classes; all others are one more class, inside which a word
has its smoothed share of the training counts, so that every text has a proper probability.

Documents are laid into lanes that are read side by side.  A lane's state is carried from window to window and set to
zero where a document begins, so a document's score is that of its whole text; in training, gradients stop at the
window's start (truncated backpropagation).  After a short start on a sample, every partition trains on all its training
documents and the partitions' parameters are averaged, weighted by their words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.session import stage

END = b""  # words are never empty
STATE, CLASS_WORDS, CLASSES = 16, 32, 32
#: Steps of truncated backpropagation, steps read at once in scoring (which changes no score), documents side by side.
WINDOW, SCORE_WINDOW, LANES = 20, 80, 512
#: Places whose classes are weighed at once, few enough for a core's own memory.
BLOCK = 1000
#: Values between the rows of a table: rows a power of two apart would push each other out of a core's cache.
GAP = 16
#: Parameters stay within this range; as states lie in (-1, 1), no exponential can overflow.
RANGE = 4.0
#: Words whose counts travel with every task; the counts of others are joined.
COMMON_WORDS = 1 << 18
START_TEXTS, START_ROUNDS = 400, 4
#: Tokens and distinct words that a task holds at a time.
HELD_TOKENS, HELD_WORDS = 2_000_000, 400_000
#: Bytes of text that are taken apart at a time.
PIECE_BYTES = 2 << 20
FAN = 16


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def pieces(batch):
    """Slices of a batch with about ``PIECE_BYTES`` of text in the last column, or with one longer text."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begins = [0, *(np.flatnonzero(np.diff(ends // PIECE_BYTES)) + 1), len(ends)]
    for begin, end in zip(begins, begins[1:]):
        if begin < end:
            yield batch.slice(begin, end - begin)


def words_in(texts):
    """``words_of`` all texts of an Arrow array one after another, and the number of the text of each."""
    import pyarrow as pa
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, text = split.flatten(), pc.list_parent_indices(split)
    there = pc.greater(pc.binary_length(words), 0)  # space at a text's begin or end leaves an empty word
    if not pc.all(there, min_count=0).as_py():
        words, text = words.filter(there), text.filter(there)
    return words.cast(pa.binary()), text.to_numpy()


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


class Network:
    """Parameters and passes.  Token 0 is the end, 1 any rarer word, the rest are frequent words by falling count."""

    shapes = {"embed": (CLASSES * CLASS_WORDS + 2, STATE), "wx": (STATE, 3 * STATE), "b": (3 * STATE,),
              "uzr": (STATE, 2 * STATE), "uh": (STATE, STATE), "cw": (STATE, CLASSES + 2), "cb": (CLASSES + 2,),
              "ww": (CLASSES, STATE, CLASS_WORDS), "wb": (CLASSES, CLASS_WORDS)}

    def __init__(self, flat=None):
        import numpy as np

        sizes = [int(np.prod(s)) for s in self.shapes.values()]
        if flat is None:
            flat = (np.random.default_rng(7).standard_normal(sum(sizes)) * 0.15).astype(np.float32)
        self.flat = flat
        at = 0
        for (name, shape), n in zip(self.shapes.items(), sizes):
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @staticmethod
    def parts(tokens):
        """Class and place in it: the end and the rare words are classes without places."""
        import numpy as np

        frequent = tokens >= 2
        return np.where(frequent, (tokens - 2) // CLASS_WORDS + 2, tokens), np.where(frequent, (tokens - 2) % CLASS_WORDS, 0)

    def gates(self):
        """Weights of z and r, which read state, word and 1, and of c, which reads word, 1 and r * state."""
        import numpy as np

        wx, b, two = self.wx, self.b[None], 2 * STATE
        return np.vstack([self.uzr, wx[:, :two], b[:, :two]]), np.vstack([wx[:, two:], b[:, two:], self.uh])

    def states(self, inputs, keep, h, hold=True):
        """States after each step of a window (steps x lanes), what led to them step by step, and the last state.

        A step is what the gates read, z, r, r * state, c, state after; unless ``hold``, steps are not kept.  All are
        lanes x values to the caller, but a value's lanes lie together: numpy is slow on rows of 16.
        """
        import numpy as np

        kind, width = self.flat.dtype, inputs.shape[1]
        of_zr, of_c = (np.ascontiguousarray(w.T) for w in self.gates())
        of_zr *= 0.5  # a sigmoid of x is half of 1 + tanh(x / 2)
        embed = np.ascontiguousarray(self.embed.T)
        hidden = rows(STATE, inputs.size, kind).reshape(STATE, *inputs.shape)
        room = [rows(6 * STATE + 1, width, kind) for _ in range(len(inputs) if hold else 1)]
        steps = []
        h = h.T
        for t, tokens in enumerate(inputs.astype(np.intp)):
            of_step, new = room[t if hold else 0], hidden[:, t]
            read, zr, c = of_step[: 3 * STATE + 1], of_step[3 * STATE + 1 : -STATE], of_step[-STATE:]
            before, rh, z, r = read[:STATE], read[-STATE:], zr[:STATE], zr[STATE:]
            np.multiply(h, keep[t], out=before)
            embed.take(tokens, axis=1, out=read[STATE : 2 * STATE], mode="clip")
            read[2 * STATE] = 1
            np.matmul(of_zr, read[: 2 * STATE + 1], out=zr)
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            np.multiply(r, before, out=rh)
            np.matmul(of_c, read[STATE:], out=c)
            np.tanh(c, out=c)
            np.subtract(c, before, out=new)
            new *= z
            new += before
            if hold:
                steps.append(tuple(x.T for x in (read, z, r, rh, c, new)))
            h = new
        return hidden.transpose(1, 2, 0), steps, h.T

    def outputs(self, hidden, targets, grads=None):
        """log P of every target; with ``grads``, also adds gradients and returns the states' gradient."""
        import numpy as np

        n, kind = len(hidden), hidden.dtype
        cls, place = self.parts(targets)
        hidden = hidden.T
        log_p, back = np.empty(n, kind), None if grads is None else rows(STATE, n, kind)
        for at in range(0, n, BLOCK):
            block = slice(at, at + BLOCK)
            log_p[block], p = self._log_p(self.cw, self.cb, hidden[:, block], cls[block], grads is not None)
            if grads is not None:
                grads["cw"] += hidden[:, block] @ p.T
                grads["cb"] += p.sum(axis=1)
                np.matmul(self.cw, p, out=back[:, block])
        # Frequent words, sorted by class once, so that each class is a slice.
        order = np.flatnonzero(cls >= 2)
        order = order[np.argsort(cls[order].astype(np.int16), kind="stable")]
        bounds = np.searchsorted(cls[order], np.arange(2, CLASSES + 3))
        owns = [(c, slice(*bounds[c : c + 2])) for c in range(CLASSES) if bounds[c] < bounds[c + 1]]
        own, inner = hidden.take(order, axis=1, mode="clip"), np.empty((CLASS_WORDS, len(order)), kind)
        for c, part in owns:
            np.matmul(self.ww[c].T, own[:, part], out=inner[:, part])
            inner[:, part] += self.wb[c][:, None]
        found, p = self._picked(inner, place[order], grads is not None)
        log_p[order] += found
        if grads is not None:
            # The last column is for all other places.
            back_own = np.zeros((STATE, len(order) + 1), kind)
            for c, part in owns:
                grads["ww"][c] += own[:, part] @ p[:, part].T
                grads["wb"][c] += p[:, part].sum(axis=1)
                np.matmul(self.ww[c], p[:, part], out=back_own[:, part])
            column = np.full(n, len(order))
            column[order] = np.arange(len(order))
            back += back_own.take(column, axis=1, mode="clip")
        return log_p, None if back is None else back.T

    def _log_p(self, weights, bias, hidden, at, grad):
        import numpy as np

        logits = weights.T @ hidden
        logits += bias[:, None]
        return self._picked(logits, at, grad)

    @staticmethod
    def _picked(logits, at, grad):
        """log P of the choice ``at`` of every column; with ``grad``, also its gradient.  The logits are overwritten."""
        import numpy as np

        flat, places = logits.reshape(-1), at * logits.shape[1] + np.arange(logits.shape[1])
        log_p = flat[places]
        np.exp(logits, out=logits)
        total = np.ones(len(logits), logits.dtype) @ logits
        log_p -= np.log(total)
        if grad:
            logits /= total
            flat[places] -= 1
        return log_p, logits

    def gradients(self, inputs, targets, keep, valid, h):
        """Gradients over one window, its mean loss and the state after it."""
        import numpy as np

        flat = np.zeros_like(self.flat)
        grads = vars(Network(flat))
        hidden, steps, last = self.states(inputs, keep, h)
        log_p, back = self.outputs(columns(hidden, valid), targets[valid], grads)
        width, kind = inputs.shape[1], hidden.dtype
        into = back.T
        if not valid.all():
            into = rows(STATE, inputs.size, kind)
            into[:] = 0
            into[:, valid.ravel()] = back.T
        into = into.reshape(STATE, *inputs.shape)
        of_words = rows(STATE, inputs.size, kind).reshape(into.shape)
        dh, stay, dzr, dc = (rows(n * STATE, width, kind) for n in (1, 1, 2, 1))
        dh[:] = 0
        dz, dr = dzr[:STATE], dzr[STATE:]
        of_zr, of_c = self.gates()
        g_zr, g_c = np.zeros_like(of_zr), np.zeros_like(of_c)
        for t in range(len(inputs) - 1, -1, -1):
            read, z, r, rh, c, _ = (x.T for x in steps[t])
            dh += into[:, t]
            np.subtract(1, z, out=stay)
            np.multiply(c, c, out=dc)
            np.subtract(1, dc, out=dc)
            dc *= z
            dc *= dh
            np.subtract(c, read[:STATE], out=dz)
            dz *= z
            dz *= stay
            dz *= dh
            from_c = of_c @ dc
            drh = from_c[-STATE:]
            np.subtract(1, r, out=dr)
            dr *= rh
            dr *= drh
            from_zr = of_zr @ dzr
            g_zr += read[: 2 * STATE + 1] @ dzr.T
            g_c += read[STATE:] @ dc.T
            np.add(from_c[:STATE], from_zr[STATE : 2 * STATE], out=of_words[:, t])
            dh *= stay
            drh *= r
            dh += drh
            dh += from_zr[:STATE]
            dh *= keep[t]
        grads["uzr"] += g_zr[:STATE]
        grads["uh"] += g_c[-STATE:]
        grads["wx"] += np.hstack([g_zr[STATE : 2 * STATE], g_c[:STATE]])
        grads["b"] += np.hstack([g_zr[-1], g_c[STATE]])
        # A token's places are added up, value by value.
        tokens = inputs.ravel().astype(np.intp)
        for k in range(STATE):
            grads["embed"][:, k] += np.bincount(tokens, of_words[k].ravel(), len(self.embed))
        return flat / max(1, int(valid.sum())), float(-log_p.mean()) if len(log_p) else 0.0, last


def columns(hidden, valid):
    """The states of the valid places, a row each to the caller, laid out as columns."""
    values = hidden.transpose(2, 0, 1).reshape(hidden.shape[2], -1)
    return (values if valid.all() else values[:, valid.ravel()]).T


def rows(n, width, kind):
    """Room for ``n`` rows, with a gap between them."""
    import numpy as np

    return np.empty((n, width + GAP), kind)[:, :width]


def lanes(texts: list, window: int = WINDOW):
    """Windows over documents laid into lanes: (inputs, targets, keep, valid, document of each place) arrays.

    The longest documents go first, each to the lane with the fewest tokens so far; lanes are then ordered by length, so
    that later windows are narrower.
    """
    import heapq

    import numpy as np

    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    held: list[list[int]] = [[] for _ in range(min(LANES, len(texts)))]
    heap = [(0, k) for k in range(len(held))]
    for i in order:
        n, k = heapq.heappop(heap)
        held[k].append(i)
        heapq.heappush(heap, (n + len(texts[i]), k))
    held.sort(key=lambda own: -sum(len(texts[i]) for i in own))
    lengths = np.array([sum(len(texts[i]) for i in own) for own in held])
    # All lanes one after another; a window picks its places, so a long document costs no more than its length.
    laid = [i for own in held for i in own]
    tokens = np.concatenate([texts[i] for i in laid])
    sizes = np.array([len(texts[i]) for i in laid])
    document = np.repeat(np.array(laid, np.int32), sizes)
    first = np.zeros(len(tokens), bool)
    first[np.cumsum(sizes) - sizes] = True
    offsets = np.cumsum(lengths) - lengths
    for at in range(0, int(lengths[0]), window):
        wide = int((lengths > at).sum())
        step = np.arange(at, min(at + window, int(lengths[0])))[:, None]
        valid = step < lengths[None, :wide]
        place = offsets[None, :wide] + np.minimum(step, lengths[None, :wide] - 1)
        begins = first[place]
        # Before a document's first word the network reads the end token, 0.
        inputs = np.where(begins, 0, tokens[place - 1])
        yield inputs, tokens[place], np.where(begins, np.float32(0), np.float32(1)), valid, document[place]


def learn(network: Network, texts: list, rate: float, memory=None):
    """Train on documents by Adam; returns the optimiser's memory."""
    import numpy as np

    first, second, n = memory or (np.zeros_like(network.flat), np.zeros_like(network.flat), 0)
    h = None
    for inputs, targets, keep, valid, _ in lanes(texts):
        h = np.zeros((inputs.shape[1], STATE), np.float32) if h is None else h[: inputs.shape[1]]
        g, _, h = network.gradients(inputs, targets, keep, valid, h)
        n += 1
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        network.flat -= rate * (first / (1 - 0.9**n)) / (np.sqrt(second / (1 - 0.99**n)) + 1e-6)
        np.clip(network.flat, -RANGE, RANGE, out=network.flat)
    return first, second, n


def log10_scores(network: Network, texts: list):
    """log10 P of every document, rare words up to their class."""
    import numpy as np

    out = np.zeros(len(texts))
    h = None
    for inputs, targets, keep, valid, document in lanes(texts, SCORE_WINDOW):
        h = np.zeros((inputs.shape[1], STATE), np.float32) if h is None else h[: inputs.shape[1]]
        hidden, _, h = network.states(inputs, keep, h, hold=False)
        log_p, _ = network.outputs(columns(hidden, valid), targets[valid])
        out += np.bincount(document[valid], log_p, len(texts))
    return out / np.log(10)


@dataclass
class Vocabulary:
    """The common training words by falling count; the first of them are the network's own."""

    words: list[bytes]
    counts: list[int]
    total: int
    distinct: int
    own: int

    def values(self, n: int | None = None):
        """The first words as an Arrow array."""
        import pyarrow as pa

        return pa.array(self.words[:n], pa.binary())


def word_counts(rows: DataFrame) -> DataFrame:
    """(``word``, ``n``) over the texts of ``rows`` (one column ``text``), the end of each text included."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            for piece in pieces(batch):
                found = words_in(piece.column(0))[0].value_counts()
                words, times = (found.field(k).to_numpy(zero_copy_only=False).tolist() for k in (0, 1))
                seen.update(dict(zip(words, times)))
                seen[END] += len(piece)
                if len(seen) > HELD_WORDS:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return rows.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, common: int = COMMON_WORDS) -> Vocabulary:
    """The most frequent words, at most ``common`` of them: all with at least the smallest count that keeps to it."""
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()  # one row per different count
    total, distinct = sum(r.n * r.k for r in sizes), sum(r.k for r in sizes)
    least, held = None, 0
    for r in sorted(sizes, key=lambda r: -r.n):
        if held + r.k > common:
            break
        least, held = r.n, held + r.k
    if least is None:
        return Vocabulary([], [], total, distinct, 0)
    top = counts.where((F.col("n") >= least) & (F.col("word") != F.lit(END))).toArrow()
    rows = sorted(zip(top.column("n").to_pylist(), top.column("word").to_pylist()), key=lambda x: (-x[0], x[1]))
    return Vocabulary([w for _, w in rows], [n for n, _ in rows], total, distinct, min(len(rows), CLASSES * CLASS_WORDS))


def places_in(words, common):
    """Where the words stand in ``common`` (-1: nowhere)."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.index_in(words, value_set=common), -1).to_numpy()


def network_tokens(at, text, n_texts: int, own: int) -> list:
    """The network's tokens of every text, which end with the end token."""
    import numpy as np

    sizes = np.bincount(text, minlength=n_texts) + 1
    tokens = np.zeros(int(sizes.sum()), np.int32)
    tokens[np.arange(len(at)) + text] = np.where((at >= 0) & (at < own), at + 2, 1)
    ends = np.cumsum(sizes).tolist()
    return [tokens[a:b] for a, b in zip([0, *ends], ends)]


def train(rows: DataFrame, vocab: Vocabulary, n_texts: int, rate: float = 0.01) -> Network:
    """The averaged network over all ``n_texts`` texts of ``rows`` (columns ``key``, ``text``)."""
    import numpy as np
    import pyarrow as pa

    # A start that all partitions share, from about as many texts at any size, picked by a hash of the key.
    start = Network()
    share = min(1.0, START_TEXTS / max(1, n_texts))
    picked = rows.where(F.pmod(F.xxhash64(F.lit("start"), "key"), F.lit(1_000_000_000)) < int(share * 1_000_000_000))
    sample = [r.text for r in picked.orderBy("key", "text").select("text").collect()]
    own = vocab.own
    own_words = vocab.values(own)

    def tokens(texts) -> list:
        words, text = words_in(texts)
        return network_tokens(places_in(words, own_words), text, len(texts), own)

    texts = tokens(pa.array(sample, pa.string()))
    memory = None
    for _ in range(START_ROUNDS if texts else 0):
        memory = learn(start, texts, rate, memory)
    begin = start.flat.copy()

    def run(batches: Iterator) -> Iterator:
        network, memory, n, held, total = Network(begin.copy()), None, 0, [], 0
        for batch in batches:
            for piece in pieces(batch):
                for text in tokens(piece.column(0)):
                    held.append(text)
                    n += len(text)
                    if n >= HELD_TOKENS:
                        memory = learn(network, held, rate / 3, memory)
                        total, n, held = total + n, 0, []
        if held:
            learn(network, held, rate / 3, memory)
            total += n
        if total:
            yield pa.RecordBatch.from_pydict({"n": pa.array([total], pa.int64()),
                                              "flat": pa.array([network.flat.astype(float) * total], pa.list_(pa.float64()))})

    def add(batches: Iterator) -> Iterator:
        total, flat = 0, None
        for batch in batches:
            for n, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = x.values.to_numpy()
                total, flat = total + n, x if flat is None else flat + x
        if total:
            yield pa.RecordBatch.from_pydict({"n": pa.array([total], pa.int64()), "flat": pa.array([flat], pa.list_(pa.float64()))})

    schema = "n bigint, flat array<double>"
    parts = stage(rows.select("text").mapInArrow(run, schema), "networks")
    n = parts.count()
    while n > FAN:
        n = -(-n // FAN)
        parts = stage(parts.repartition(n).mapInArrow(add, schema), "networks")
        n = parts.count()
    found = parts.collect()  # at most FAN rows
    if not found:
        return start
    weight = sum(r.n for r in found)
    return Network((np.sum([r.flat for r in found], axis=0) / weight).astype(np.float32))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``) of every row.

    A null text counts as empty: it has the end as its only token.  Rows with a null id count as the id of an empty
    text; repeated rows are learnt from and scored each.  An empty table gives an empty result; without training rows
    every word is unknown.  Other columns are left out.
    """
    import math

    import numpy as np
    import pyarrow as pa

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    training = rows.where(~F.col("held_out")).select(F.col("id").alias("key"), "text")
    counts = stage(word_counts(training.select("text")), "word-counts")
    vocab = vocabulary(counts)
    ends = counts.where(F.col("word") == F.lit(END)).first()
    n_ends = ends.n if ends else 0
    network = train(training, vocab, n_ends)
    flat = network.flat
    n_all, v_all = vocab.total, vocab.distinct
    base_floor = 0.5 * (v_all + 1)
    # The class of rarer words: what is neither the end nor the network's own.
    n_rare = n_all - n_ends - sum(vocab.counts[: vocab.own])
    rare_floor = 0.5 * (v_all - vocab.own - bool(n_ends) + 1)

    def run(batches: Iterator) -> Iterator:
        network, common = Network(flat), vocab.values()
        logs = np.log10(np.array([*vocab.counts, 0.5]) + 0.5)  # the last, for words that are joined later, is log10(1)
        base_all, rare_all = math.log10(n_all + base_floor), math.log10(n_rare + rare_floor)
        end_log = math.log10(n_ends + 0.5) - base_all

        def lists(offsets, values):
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

        def read(piece):
            """The columns of a piece's rows but the network's share of the score, and the network's tokens."""
            n, (words, text) = len(piece), words_in(piece.column(2))
            at = places_in(words, common)
            part, rare, known = logs[at], (at < 0) | (at >= vocab.own), at >= 0
            times = np.bincount(text, minlength=n)
            times_rare = np.bincount(text[rare], minlength=n)
            # The other words, each once per text.
            unknown = words.filter(pa.array(~known)).dictionary_encode()
            k = max(1, len(unknown.dictionary))
            pairs, pair_times = np.unique(text[~known].astype(np.int64) * k + unknown.indices.to_numpy(), return_counts=True)
            offsets = np.searchsorted(pairs, np.arange(n + 1, dtype=np.int64) * k)
            columns = [piece.column(0), piece.column(1), pa.array(times + 1, pa.int64()),
                       pa.array(np.bincount(text[known], minlength=n) + bool(n_ends), pa.int64()),
                       pa.array(np.bincount(text, part, n) - times * base_all + end_log, pa.float64()),
                       pa.array(np.bincount(text[rare], part[rare], n) - times_rare * rare_all, pa.float64()),
                       lists(offsets, unknown.dictionary.take(pa.array(pairs % k))), lists(offsets, pa.array(pair_times, pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names), network_tokens(at, text, n, vocab.own)

        names = ["id", "held_out", "n_tokens", "n_known", "base_part", "score_part", "words", "times"]

        def out(parts, texts):
            table = pa.Table.from_batches(parts).combine_chunks()
            full = pa.array(table.column("score_part").to_numpy() + log10_scores(network, texts), pa.float64())
            return table.set_column(names.index("score_part"), "score_part", full).to_batches()

        # Texts of several batches are read side by side: few would leave most lanes empty beside a long text.
        parts, texts, n = [], [], 0
        for batch in batches:
            for piece in pieces(batch):
                part, tokens = read(piece)
                parts.append(part)
                texts += tokens
                n += sum(map(len, tokens))
                if n >= HELD_TOKENS:
                    yield from out(parts, texts)
                    parts, texts, n = [], [], 0
        if texts:
            yield from out(parts, texts)

    kind = docs.schema[id_col].dataType.simpleString()
    scored = rows.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_part double, "
                                  "score_part double, words array<binary>, times array<bigint>")
    scored = stage(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    # Words beyond the common ones: their counts are joined, per text and word.
    asked = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select(
        "row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    joined = asked.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"))
    full = scored.drop("words", "times").join(joined, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return full.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base_part") + more).alias("base_score"),
        (F.col("score_part") + more).alias("score"))
