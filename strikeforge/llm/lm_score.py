"""Log probability of texts under a logistic mixture of hashed-context bit predictors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeforge.llm.shared import id_key, id_of, pieces
from strikeforge.sources.tables import Stage

#: Stands for the end of a text; no word holds it.
END = "\n"
#: Before the beginning of a text's first token; before tokens whose beginnings are priced apart.
FIRST, REST = "\t", "\r"
#: Bytes of the word before that a token's contexts reach; a space follows them.
TAIL = 3
#: Tokens priced inside the tasks that read the texts, and their longest in bytes.
COMMON_TOKENS = 300_000
COMMON_BYTES = 64
#: Distinct tokens of a task that trains or prices, about.
TASK_TOKENS = 50_000
#: Contexts: so many bytes before, also over the token's start, and the token's whole beginning.
ORDERS = (1, 2, TAIL + 1)
#: Up to so many bytes, the counts of beginnings are gathered with those of fixed order.
HEAD = ORDERS[-1]
N_INPUTS = len(ORDERS) + 1
PRIOR = 0.4
#: Weight sets: how often the longest context was seen (4 steps) and the bit's place.
CONFIDENCE = (0.5, 3.0, 30.0)
N_GATES = (len(CONFIDENCE) + 1) * 8
#: Steps of the refinement's scale, over log odds from -8 to 8.
REFINE_STEPS = 33
REFINE_PRIOR = 16.0
#: Bytes whose bits are priced at once.
CHUNK = 32768
RATE = 0.15
LEAST = 1 / 65536


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """All tokens of a batch of texts without the ends: row number and token."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    rows, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    return rows.filter(full).to_numpy(), flat.filter(full)


def _cut(tokens: pa.Array, where) -> pa.Array:
    """A run of whole characters of each token: ``where`` gives its ends from the bytes and the token's."""
    offsets = np.frombuffer(tokens.buffers()[1], "i8")[tokens.offset : tokens.offset + len(tokens) + 1]
    octets = np.frombuffer(tokens.buffers()[2] or b"", "u1")
    first, end = where(np.append(octets & 0xC0 == 0x80, False), offsets[:-1], offsets[1:])
    sizes = end - first
    into = np.append(0, np.cumsum(sizes)).astype("i8")
    at = np.repeat(first - into[:-1], sizes) + np.arange(into[-1])
    buffers = [None, pa.py_buffer(into), pa.py_buffer(octets[at])]
    return pa.Array.from_buffers(pa.large_string(), len(sizes), buffers)


def _last(inside, first, end):
    """``TAIL`` bytes at most, from the first character that is whole."""
    start = np.maximum(end - TAIL, first)
    for _ in range(TAIL):
        start = start + (inside[start] & (start < end))
    return start, end


def _beginning(inside, first, end):
    """``HEAD`` bytes and what is left of the last one's character."""
    stop = np.minimum(first + HEAD, end)
    for _ in range(3):
        stop = stop + (inside[stop] & (stop < end))
    return first, stop


def _distinct(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values and the place of each value among them."""
    coded = pc.dictionary_encode(values)
    return coded.dictionary, coded.indices.to_numpy()


@dataclass
class Placed:
    """All tokens of a batch of texts, ends too: row number, size in bytes, place among ``heads`` and ``rests``.

    A head is the beginning of a token after the last bytes of the word before and a space, or after
    ``FIRST``; a rest is the whole token after ``REST``. Only a token's first ``HEAD`` bytes have a context
    that reaches over its start: a head stands for these, a rest for those that follow.
    The distinct ones are cut and joined once per batch.
    """

    rows: np.ndarray
    sizes: np.ndarray
    heads: pa.Array
    head: np.ndarray
    rests: pa.Array
    rest: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Placed:
        rows, words = words_of(texts)
        n = len(texts)
        names, word = _distinct(words)
        names = pa.concat_arrays([names, pa.array([END], names.type)]).cast(pa.large_string())
        rest = np.full(len(rows) + n, len(names) - 1, "i4")
        rest[np.arange(len(rows)) + rows] = word
        n_tokens = np.bincount(rows, minlength=n) + 1
        mark = lambda text: pa.scalar(text, pa.large_string())
        join = pc.binary_join_element_wise
        tails, tail = _distinct(_cut(names, _last))
        tails = pa.concat_arrays([join(tails, mark(""), mark(" ")), pa.array([FIRST], pa.large_string())])
        starts, start = _distinct(_cut(names, _beginning))
        before = np.append(0, tail[rest[:-1]]).astype("i8")
        before[np.cumsum(n_tokens) - n_tokens] = len(tails) - 1
        pairs, head = _distinct(pa.array(before * len(starts) + start[rest]))
        pairs = pairs.to_numpy()
        heads = join(tails.take(pa.array(pairs // len(starts))), starts.take(pa.array(pairs % len(starts))), mark(""))
        rests = join(mark(REST), names, mark(""))
        sizes = pc.binary_length(names).to_numpy()[rest]
        return cls(np.repeat(np.arange(n), n_tokens), sizes, heads.cast(words.type), head, rests.cast(words.type), rest)


def placed_tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """All tokens of a batch of texts, ends too: row number, heads and rests, size in bytes."""
    placed = Placed.of(texts)
    own = (names.take(pa.array(at)) for names, at in ((placed.heads, placed.head), (placed.rests, placed.rest)))
    return placed.rows, *own, placed.sizes


def is_rest(token: str = "token") -> Column:
    return F.col(token).startswith(REST)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text (none for NULL) divides by ten."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 10 == 0


# -- tokens of the corpus


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 4096):
        held = batch.column(0).to_numpy(zero_copy_only=False)
        placed = Placed.of(batch.column(1))
        taught = ~held[placed.rows]
        for names, at in ((placed.heads, placed.head), (placed.rests, placed.rest)):
            n_train, n_all = (np.bincount(own, minlength=len(names)) for own in (at[taught], at))
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(n_train), pa.array(n_all)], ["token", "n_train", "n_all"]
            )


def token_counts(rows: DataFrame) -> DataFrame:
    """``token, n_train, n_all`` of ``rows(held, text)``: heads and rests of ``placed_tokens``."""
    counted = rows.select("held", "text").mapInArrow(_count, "token string, n_train long, n_all long")
    return counted.groupBy("token").agg(
        F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all")
    )


# -- the model: every bit of a token, spelled with a space at its end


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    return np.flatnonzero(first)


@dataclass
class Edges:
    """Training counts by context and next byte, sorted: a key is 56 bits of context and the byte."""

    keys: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, weights: np.ndarray) -> Edges:
        names, place = np.unique(keys, return_inverse=True)
        return cls(names, np.bincount(place, weights, len(names)))

    def paths(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per distinct key and bit of its byte: ones and all bits seen there; and the row of each key.

        All bytes that share a context and the bits so far stand together, so sums over runs
        give the counts of every node. Only the contexts asked for are unfolded.
        """
        wanted, row = np.unique(keys, return_inverse=True)
        context = wanted >> np.uint64(8) << np.uint64(8)
        context = context[_starts(context)]
        first = np.searchsorted(self.keys, context)
        sizes = np.searchsorted(self.keys, context | np.uint64(255), "right") - first
        own = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        names = np.sort(np.concatenate((wanted, self.keys[own])))
        names = names[_starts(names)]
        n = np.zeros(len(names))
        n[np.searchsorted(names, self.keys[own])] = self.n[own]
        ones, seen = np.zeros((2, len(names), 8))
        for bit in range(8 if len(names) else 0):
            node = names >> np.uint64(8 - bit)
            runs = _starts(node)
            of_run = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(names))))
            is_one = (names >> np.uint64(7 - bit)) & np.uint64(1)
            seen[:, bit] = np.add.reduceat(n, runs)[of_run]
            ones[:, bit] = np.add.reduceat(n * is_one, runs)[of_run]
        at = np.searchsorted(names, wanted)
        return ones[at], seen[at], row


def _keys(octets: np.ndarray, place: np.ndarray, number: int, order: int) -> np.ndarray:
    """The bytes before each byte, ``order`` at most and from place 0 on, and the byte."""
    value = np.where(octets == ord(FIRST), 0, octets.astype("u8") + np.uint64(1))
    context = np.zeros(len(octets), "u8")
    for back in range(1, order + 1):
        before = np.where(place[back:] >= back, value[:-back], 0)
        context *= np.uint64(263)  # also the first bytes of the batch, which have none so far back
        context[back:] += before.astype("u8")
    context |= np.uint64(number << 40)  # four bytes stay below 2 to the 33: no two share a key
    return context << np.uint64(8) | octets


@dataclass
class Spelling:
    """Bytes of many tokens: their token, place in it, and key (context and byte) per predictor.

    What precedes a head is seen by the contexts of fixed order, but is not spelled itself.
    """

    octets: np.ndarray
    token: np.ndarray
    place: np.ndarray
    keys: list[np.ndarray]

    @classmethod
    def of(cls, tokens: pa.Array) -> Spelling:
        parts = (c.cast(pa.large_binary()) for c in (tokens, pa.scalar(""), pa.scalar(" ")))
        spelled = pc.binary_join_element_wise(*parts)
        offsets = np.frombuffer(spelled.buffers()[1], "i8")
        offsets = offsets[spelled.offset : spelled.offset + len(spelled) + 1]
        octets = np.frombuffer(spelled.buffers()[2], "u1")[offsets[0] : offsets[-1]]
        sizes = np.diff(offsets)
        token = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(octets)) - np.repeat(offsets[:-1] - offsets[0], sizes)
        keys = [_keys(octets, place, number, order) for number, order in enumerate(ORDERS)]
        # A head with a word before it holds two spaces, one at its end; the first is no part of it.
        spaces = np.flatnonzero(octets == ord(" "))
        _, first, n = np.unique(token[spaces], return_index=True, return_counts=True)
        lead = octets[offsets[:-1] - offsets[0]]
        rest, marked = lead == ord(REST), (lead == ord(REST)) | (lead == ord(FIRST))
        head = (n > 1) | (lead == ord(FIRST))
        place = place - np.repeat(np.where(marked, 1, np.where(n > 1, place[spaces[first]] + 1, 0)), sizes)
        own = place >= 0
        octets, token, place, keys = octets[own], token[own], place[own], [k[own] for k in keys]
        keys.append(_keys(octets, place, len(ORDERS), HEAD))
        value = octets.astype("u8") + np.uint64(1)
        powers = np.full(int(sizes.max(initial=1)), 0x9E3779B97F4A7C15, "u8")
        powers[0] = 1
        sums = np.concatenate((np.zeros(1, "u8"), np.cumsum(
            value * np.multiply.accumulate(powers)[place], dtype="u8")))
        whole = (sums[:-1] - sums[np.arange(len(octets)) - place]) * np.uint64(0xD6E8FEB86659FD93)
        whole = (whole ^ (whole >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        keys.append(whole >> np.uint64(8) << np.uint64(8) | octets)
        own = np.where(place < HEAD, ~rest[token], ~head[token])
        return cls(octets[own], token[own], place[own], [k[own] for k in keys])


def slices(n: int) -> Iterator[slice]:
    return (slice(start, start + CHUNK) for start in range(0, n, CHUNK))


def cell_of(mixed: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Cell of the refinement: node and step of the mixture."""
    return nodes * REFINE_STEPS + np.rint((mixed + 8) * (REFINE_STEPS - 1) / 16).astype("i8")


@dataclass
class Cases:
    """Bytes of many tokens: their token and case. All bytes with equal contexts and value are one case,
    predicted once. Per predictor, ``Edges.paths`` of the cases."""

    token: np.ndarray
    row: np.ndarray
    octets: np.ndarray
    paths: list[tuple]

    def bits(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of some cases and their nodes."""
        octets, places = self.octets[own].astype("i8")[:, None], np.arange(7, -1, -1)
        return (octets >> places & 1).astype("f8"), (octets | 256) >> (places + 1)

    def odds(self, less: float) -> Callable:
        """What gives the log odds of a one by each predictor and the gates of some cases, as if each bit was
        seen ``less`` often. Both are computed once per distinct context and byte."""
        found, places = [], np.arange(7, -1, -1)
        for ones, seen, row in self.paths:
            if less:
                octets = np.zeros(len(ones), "i8")
                octets[row] = self.octets
                ones = np.maximum(ones - less * (octets[:, None] >> places & 1), 0)
                seen = np.maximum(seen - less, ones)
            found.append((np.log((ones + PRIOR) / (seen - ones + PRIOR)), row))
        gate = np.digitize(seen, CONFIDENCE) * 8 + np.arange(8)  # the longest context is the last
        return lambda own: ([inputs[row[own]] for inputs, row in found], gate[row[own]])


@dataclass
class Model:
    """What prices tokens: counts of the contexts of fixed order, gated weights, refinement.

    Counts of whole beginnings longer than ``HEAD`` are not part of it: tokens that share one are
    trained and priced in the same task, which counts them itself.
    """

    edges: Edges
    weights: np.ndarray
    refine: np.ndarray

    @classmethod
    def untrained(cls) -> Model:
        centers = np.linspace(-8, 8, REFINE_STEPS)
        refine = np.tile(1 / (1 + np.exp(-centers)), (256, 1))
        start = np.full((N_GATES, N_INPUTS), 0.4)
        return cls(Edges(np.zeros(0, "u8"), np.zeros(0)), start, refine)

    def cases(self, tokens: pa.Array, n_train: np.ndarray) -> Cases:
        """``tokens`` holds all that share a beginning over ``HEAD``."""
        spelling = Spelling.of(tokens)
        long = spelling.place >= HEAD
        # The longest context of fixed order holds the shorter ones and, up to ``HEAD``, the beginning.
        near = spelling.keys[len(ORDERS) - 1][~long] | spelling.place[~long].astype("u8") << np.uint64(52)
        short, beyond = np.unique(near, return_inverse=True), np.unique(spelling.keys[-1][long], return_inverse=True)
        row, one = np.empty(len(long), "i8"), np.empty(len(short[0]) + len(beyond[0]), "i8")
        row[~long], row[long] = short[1], beyond[1] + len(short[0])
        one[row] = np.arange(len(row))
        paths = [self.edges.paths(keys[one]) for keys in spelling.keys[:-2]]
        n = np.bincount(beyond[1], n_train[spelling.token[long]], len(beyond[0]))
        begun, whole = one[: len(short[0])], Edges(beyond[0], n).paths(beyond[0])
        begun = self.edges.paths(spelling.keys[-2][begun])
        longest = (np.concatenate(c) for c in zip(begun[:2], whole[:2]))
        paths.append((*longest, np.append(begun[2], whole[2] + len(begun[0]))))
        return Cases(spelling.token, row, spelling.octets[one], paths)

    def chunks(self, tokens: pa.Array, n_train: np.ndarray) -> Iterator[tuple]:
        """Per chunk of bytes: token numbers, bits, their nodes, and per predictor the counts of
        ones and of all bits in training. ``tokens`` holds all that share a beginning over ``HEAD``."""
        cases = self.cases(tokens, n_train)
        for here in slices(len(cases.row)):
            own = cases.row[here]
            found = [(ones[row[own]], seen[row[own]]) for ones, seen, row in cases.paths]
            yield cases.token[here], *cases.bits(own), found

    def mix(self, inputs: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        mixed = sum(own * weights[gate] for own, weights in zip(inputs, self.weights.T.copy()))
        return np.clip(mixed, -8, 8, out=mixed)

    def refined(self, mixed, nodes) -> np.ndarray:
        """Half the mixture, half what came of such mixtures at such a node."""
        one = (1 / (1 + np.exp(-mixed)) + self.refine.ravel()[cell_of(mixed, nodes)]) / 2
        return np.clip(one, LEAST, 1 - LEAST, out=one)

    def log10(self, tokens: pa.Array, n_train: np.ndarray | None = None) -> np.ndarray:
        """The log10 probability of each token."""
        cases = self.cases(tokens, np.zeros(len(tokens)) if n_train is None else n_train)
        odds, price = cases.odds(0.0), np.zeros(len(cases.octets))
        for here in slices(len(price)):
            own = np.arange(len(price))[here]
            bits, nodes = cases.bits(own)
            one = self.refined(self.mix(*odds(own)), nodes)
            price[here] = np.log10(np.where(bits > 0, one, 1 - one).prod(1))  # at least LEAST ** 8
        return np.bincount(cases.token, price[cases.row], len(tokens))


def _edge_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training counts by context of fixed order and next byte, of some tokens at a time."""
    for batch in pieces(batches, 32768):
        weight = batch.column(1).to_numpy().astype("f8")
        spelling = Spelling.of(batch.column(0))
        short = spelling.place < HEAD
        keys, n = [*spelling.keys[:-2], spelling.keys[-2][short]], weight[spelling.token]
        edges = Edges.of(np.concatenate(keys), np.concatenate((np.tile(n, len(ORDERS)), n[short])))
        yield pa.RecordBatch.from_arrays(
            [pa.array(edges.keys.astype("i8")), pa.array(edges.n.astype("i8"))], ["edge", "n"]
        )


def _gathered(batches: Iterable[pa.RecordBatch]) -> pa.Table | None:
    """All tokens of a task; there are about ``TASK_TOKENS`` of them."""
    held = list(batches)
    return pa.Table.from_batches(held).combine_chunks() if sum(b.num_rows for b in held) else None


def _train(shared):
    """One pass of online mixing over a task's tokens; returns weights and refinement sums."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        model = Model(model.edges, model.weights.copy(), model.refine)
        total, step = 0.0, 0
        refine = np.zeros((2, 256, REFINE_STEPS))
        rows = _gathered(batches)
        if rows is None:
            return
        weight = rows["n_train"].to_numpy().astype("f8")
        cases = model.cases(rows["token"].combine_chunks(), weight)
        odds = cases.odds(1.0)
        for here in slices(len(cases.row)):
            mass = np.bincount(cases.row[here], weight[cases.token[here]])
            own = np.flatnonzero(mass)
            bits, nodes = cases.bits(own)
            inputs, gate = odds(own)
            each = np.repeat(mass[own], 8).reshape(-1, 8)
            mixed = model.mix(inputs, gate)
            cell = cell_of(mixed, nodes).ravel()
            for k, value in enumerate((each * bits, each)):
                refine[k] += np.bincount(cell, value.ravel(), refine[k].size).reshape(256, -1)
            error = (bits - 1 / (1 + np.exp(-mixed))) * each
            gate = gate.ravel()
            mass = np.bincount(gate, each.ravel(), N_GATES)
            step += 1
            rate = RATE / np.sqrt(1 + step / 32)
            for k in range(N_INPUTS):
                slope = np.bincount(gate, (error * inputs[k]).ravel(), N_GATES)
                model.weights[:, k] += rate * slope / np.maximum(mass, 1e-9)
            total += each.sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array([total]), pa.array([model.weights.tobytes()]),
             pa.array([refine.tobytes()])], ["bits", "weights", "refine"],
        )

    return run


def dealt(tokens: DataFrame) -> DataFrame:
    """Distinct tokens by their first ``HEAD`` bytes, heads anyhow, in a fixed order inside each task.

    Tokens that share a longer beginning meet in one task, whose number grows with the tokens.
    """
    word = F.when(is_rest(), F.substring("token", 2, 2**31 - 1)).otherwise(F.col("token"))
    is_head = F.col("token").startswith(FIRST) | F.contains("token", F.lit(" "))
    head = F.when(is_head, F.col("token").cast("binary")).otherwise(F.substring(word.cast("binary"), 1, HEAD))
    tasks = max(1, -(-tokens.count() // TASK_TOKENS))
    return tokens.repartition(tasks, head).sortWithinPartitions(F.xxhash64("token"), "token")


def train(tokens: DataFrame) -> Model:
    """A model of the training counts in ``tokens(token, n_train)``, distinct tokens.

    Bits are counted exactly, as counts of next bytes by context: those of fixed order are grouped
    by Spark and gathered, one row per distinct context and byte; those of whole beginnings are
    counted in the task where all tokens that share one meet. Every task mixes online over its
    tokens and the weights are averaged by bits. While mixing, each bit is predicted as if it had
    been seen once less, which is how a new text meets it.
    """
    context = tokens.sparkSession.sparkContext
    used = tokens.filter("n_train > 0").select("token", "n_train")
    counted = used.mapInArrow(_edge_counts, "edge long, n long")
    table = counted.groupBy("edge").agg(F.sum("n").alias("n")).toArrow().sort_by("edge")
    model = Model.untrained()
    model.edges = Edges(table["edge"].to_numpy().astype("u8"), table["n"].to_numpy().astype("f8"))
    runs = dealt(used).mapInArrow(
        _train(context.broadcast(model)), "bits double, weights binary, refine binary"
    ).collect()
    if runs:
        runs.sort(key=lambda r: (r["bits"], r["weights"]))
        shares = np.array([r["bits"] for r in runs])
        weights = np.array([np.frombuffer(r["weights"]) for r in runs])
        model.weights = (weights * (shares / shares.sum())[:, None]).sum(0).reshape(N_GATES, N_INPUTS)
        ones, seen = sum(np.frombuffer(r["refine"]) for r in runs).reshape(2, 256, REFINE_STEPS)
        model.refine = (ones + REFINE_PRIOR * model.refine) / (seen + REFINE_PRIOR)
    return model


def _price(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _gathered(batches)
        if rows is None:
            return
        weight = rows["n_train"].to_numpy().astype("f8")
        price = shared.value.log10(rows["token"].combine_chunks(), weight)
        yield from rows.append_column("price", pa.array(price)).to_batches(8192)

    return run


# -- texts


def _common(prices: DataFrame, most: int) -> DataFrame:
    """The most frequent tokens, ``most`` at most: those above a count that a histogram of
    counts (sixteen steps per doubling) gives, so that nothing is sorted or gathered."""
    short = prices.filter(F.octet_length("token") <= COMMON_BYTES)
    step = F.floor(F.log2("n_all") * 16)
    least, total = None, 0
    for row in sorted(short.groupBy(step.alias("step")).count().collect(), reverse=True):
        total += row["count"]
        if total > most:
            break
        least = row["step"]
    return short.filter(step >= least) if least is not None else short.limit(0)


SUMS = {
    "key": "long", "mark": "long", "token": "string", "copies": "long", "n_tokens": "long",
    "n_bytes": "long", "n_known": "long", "base": "double", "price": "double",
}


def _sum_common(shared):
    """Sums over the common tokens of each text; a row for each of its other tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, *values = shared.value
        known, base, price = (np.append(v, 0.0) for v in values)  # the last one is that of all other tokens
        for batch in pieces(batches, 2048):
            n = batch.num_rows
            placed = Placed.of(batch.column(batch.schema.get_field_index("text")))
            rows = placed.rows
            tokens = pa.concat_arrays([placed.heads, placed.rests])
            place = pc.index_in(tokens, value_set=names).fill_null(len(names)).to_numpy()
            of_head, of_rest = np.split(place, [len(placed.heads)])
            add = lambda values, at, own: np.bincount(rows, values[at][own], n)
            other = place == len(names)  # joined later, one row per occurrence
            more, rest = (np.flatnonzero(c) for c in (other[:len(of_head)][placed.head], other[len(of_head):][placed.rest]))
            token = np.concatenate((placed.head[more], placed.rest[rest] + len(of_head)))
            rest = rows[np.concatenate((more, rest))]
            first = [batch.column(batch.schema.get_field_index(c)) for c in ("key", "mark")]
            # The text's own row carries a token that no other row and no word has.
            head = pa.array([f"{END}{i}:{m}" for i, m in zip(*(c.to_pylist() for c in first))])
            sums = (
                np.ones(n, "i8"), np.bincount(rows, minlength=n), np.bincount(rows, placed.sizes + 1, n).astype("i8"),
                add(known, of_rest, placed.rest).astype("i8"), add(base, of_rest, placed.rest),
                add(price, of_head, placed.head) + add(price, of_rest, placed.rest),
            )
            other = tokens.take(pa.array(token))
            columns = [pa.concat_arrays([c, c.take(pa.array(rest))]) for c in first]
            columns.append(pa.concat_arrays([head, other.cast(head.type)]))
            columns += [pa.array(np.concatenate((s, np.zeros(len(rest), s.dtype)))) for s in sums]
            yield pa.RecordBatch.from_arrays(columns, list(SUMS))

    return run


def score_texts(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
    common_tokens: int = COMMON_TOKENS,
) -> DataFrame:
    """One row per input row: what its text costs under the corpus.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``. Tokens are the
    words, A-Z lower-cased, and one end. ``base_score`` adds up smoothed unigram log10 probabilities;
    ``score`` is the log10 probability under the mixture, which spells every token byte by byte
    with a space after it. Both learn from the documents that are not held out, all of them.

    Contexts reach back over a token's start into the word before (``TAIL`` bytes of it, what a context
    of ``TAIL`` + 1 bytes sees). Only a token's first ``HEAD`` bytes have such contexts: they cost the same
    wherever the same bytes precede them, what follows costs the same everywhere. So distinct heads
    and rests are priced once, in a table.
    The ``common_tokens`` most frequent ones (of at most 64 bytes, so of bounded size) are
    broadcast and summed while texts are read; all others are joined by token, combined per text.

    A NULL or empty text is its end alone. A NULL ``doc_id`` hashes like an empty text and is held out.
    Rows repeated whole are all returned, with equal scores. Other columns are not read. With
    no training text all counts are zero and the mixture is untrained; an empty table gives
    an empty result.
    """
    spark, stage = docs.sparkSession, Stage(docs.sparkSession)
    rows = docs.select(
        id_key(doc_id).alias("key"), held_out(doc_id).alias("held"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    stage.write("counts", token_counts(rows))
    counts = stage.read("counts")
    model = spark.sparkContext.broadcast(train(counts))
    n_train, n_types = counts.filter(is_rest()).agg(
        F.coalesce(F.sum("n_train"), F.lit(0)), F.count_if(F.col("n_train") > 0)
    ).first()
    smoothed = (F.col("n_train") + 0.1) / (n_train + 0.1 * (n_types + 1))
    priced = dealt(counts).mapInArrow(_price(model), "token string, n_train long, n_all long, price double")
    # Every token has one rest, which counts for it.
    stage.write("prices", priced.select(
        "token", "n_all", "price", (is_rest() & (F.col("n_train") > 0)).cast("long").alias("hit"),
        F.when(is_rest(), F.log10(smoothed)).otherwise(0.0).alias("base"),
    ))
    prices = stage.read("prices")
    common = pa.concat_tables(
        _common(prices.filter(own), common_tokens).select("token", "hit", "base", "price").toArrow()
        for own in (is_rest(), ~is_rest())
    )
    known = common["hit"].to_numpy().astype("f8")
    names = common["token"].combine_chunks().cast(pa.string())
    table = (names, known, common["base"].to_numpy(), common["price"].to_numpy())
    marked = rows.select("key", F.xxhash64("text").alias("mark"), "text")
    kind = ", ".join(f"{name} {type_}" for name, type_ in SUMS.items())
    parts = marked.mapInArrow(_sum_common(spark.sparkContext.broadcast(table)), kind)
    rest = prices.select("token", "hit", F.col("base").alias("b"), F.col("price").alias("p"))
    joined = parts.join(rest, "token", "left")
    add = lambda own, more: F.sum(F.col(own) + F.coalesce(more, F.lit(0))).alias(own)
    sums = joined.groupBy("key", "mark").agg(
        F.sum("copies").alias("copies"), F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_bytes").alias("n_bytes"), add("n_known", "hit"), add("base", "b"), add("price", "p"),
    )
    one = lambda c: F.col(c) / F.col("copies")
    whole = lambda c: F.expr(f"{c} div copies")
    score = one("price")
    return sums.select(
        id_of("key").alias("doc_id"), "copies", whole("n_tokens").alias("n_tokens"),
        whole("n_known").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        one("base").alias("base_score"), score.alias("score"),
        (-score * float(np.log2(10)) / whole("n_bytes")).alias("bits_per_byte"),
    ).withColumn("held_out", held_out()).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
        "bits_per_byte", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))),
    ).drop("col")
