"""SentencePiece encoding and decoding: Gumbel top-k segmentations without replacement by perturbed A-star search.

The lattice of a text has an edge for every vocabulary piece, and byte pieces for characters that are no piece. Pieces
never reach over the start of a run of blanks or over a line end, so the lattice is a chain of unit lattices; each
distinct unit of a batch is built once, with backward log-sums beta as the exact A-star heuristic.

Search: the root has a Gumbel value G. A path that follows each node's most probable perturbed child keeps its G to the
end; every child left aside is a subtree with log-probability phi, whose best value is a Gumbel(phi) truncated at the G
of the path. Popping subtrees in the order of G and completing each gives the k segmentations with the largest
perturbed log-probabilities, i.e. k distinct samples without replacement. The (k+1)-th value kappa is known as well, and
1 - exp(-exp(log_prob - kappa)) is the inclusion score of a sample. All random numbers are hashes of (row key, seed,
sample, unit, position), so a row's samples don't depend on its partition.

The vocabulary file's scores are merge ranks; piece probabilities follow Zipf's law over them (1 / (rank + ZIPF)).
Encoding is lossless: decode() gives back the text, byte for byte.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm.words import chunks, mixed, prefix_hashes, span_hashes

ZIPF = 10.0
MOST_EDGES = 7_000_000
NOISE = 23.0  # above -log(-log(u)) for the largest u below 1 that uniform() gives
MARGIN = 3.0
DECODED = 1 << 16
SAMPLES = 2


class HashTable:
    """Distinct non-zero uint64 keys to int64 values, by open addressing over whole arrays."""

    def __init__(self, size: int) -> None:
        self.keys = np.zeros(1 << max(4, (2 * size - 1).bit_length()), np.uint64)
        self.values = np.full(len(self.keys), -1, np.int64)
        self.held = 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its value."""
        mask = len(self.keys) - 1
        at = (keys & np.uint64(mask)).astype(np.int64)
        found = self.keys[at]
        on = np.flatnonzero((found != keys) & (found != 0))
        while len(on):
            at[on] = (at[on] + 1) & mask
            here = self.keys[at[on]]
            found[on] = here
            on = on[(here != keys[on]) & (here != 0)]
        return found == keys, self.values[at]

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New keys, each once."""
        if 2 * (self.held + len(keys)) > len(self.keys):
            old, old_values = self.keys, self.values
            HashTable.__init__(self, 2 * (self.held + len(keys)))
            self.add(old[old != 0], old_values[old != 0])
        mask = len(self.keys) - 1
        self.held += len(keys)
        at = (keys & np.uint64(mask)).astype(np.int64)
        on = np.arange(len(keys))
        while len(on):
            free = self.keys[at[on]] == 0
            self.keys[at[on[free]]] = keys[on[free]]
            placed = self.keys[at[on]] == keys[on]
            self.values[at[on[placed]]] = values[on[placed]]
            on = on[~placed]
            at[on] = (at[on] + 1) & mask


@dataclass
class Vocabulary:
    """Pieces as bytes (blanks as blanks), log-probabilities, and all piece prefixes (id -1: no piece itself)."""

    pieces: list[bytes]
    log_prob: np.ndarray
    byte_ids: np.ndarray
    prefixes: HashTable
    data: np.ndarray  # all pieces' bytes in a row, with each one's start and size
    start: np.ndarray
    size: np.ndarray


def load_vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces, ranks, byte_ids = [b""] * n, np.full(n, np.inf), np.zeros(256, np.int64)
    lowest = max(-model.get_score(i) for i in range(n) if model.get_score(i) > -1e8)
    for i in range(n):
        if model.is_byte(i):
            value = int(model.id_to_piece(i)[3:-1], 16)
            pieces[i], byte_ids[value], ranks[i] = bytes([value]), i, 4 * lowest
        elif not (model.is_control(i) or model.is_unknown(i)):
            pieces[i] = model.id_to_piece(i).replace("▁", " ").encode()
            ranks[i] = min(-model.get_score(i), lowest)
    log_prob = -np.log(ranks + ZIPF)
    log_prob -= np.log(np.exp(log_prob[np.isfinite(log_prob)]).sum())
    table: dict[bytes, int] = {}
    for i, piece in enumerate(pieces):
        if piece and not model.is_byte(i):
            for end in range(1, len(piece)):
                table.setdefault(piece[:end], -1)
            table[piece] = i
    data = b"".join(table)
    ends = np.cumsum([len(p) for p in table])
    hashes = span_hashes(prefix_hashes(np.frombuffer(data, np.uint8)), np.concatenate(([0], ends[:-1])), ends)
    prefixes = HashTable(2 * len(table))
    prefixes.add(hashes, np.array(list(table.values())))
    size = np.array([len(p) for p in pieces])
    return Vocabulary(pieces, log_prob, byte_ids, prefixes, np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size, size)


def unit_spans(data: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """The units' start offsets in the texts' bytes (and the end): at texts, runs of blanks and line ends. A unit has any length."""
    n = len(data)
    blank, line = data == 32, data == 10
    start = np.zeros(n + 1, bool)
    start[text_start] = True
    start[1:n] |= blank[1:] & ~blank[:-1]
    start[:n] |= line
    start[1:n] |= line[:-1]
    start[n] = True
    return np.flatnonzero(start)


@dataclass
class Lattice:
    """Edges of the distinct units in order of source; positions are offsets into their joined bytes, each with one end position."""

    first: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    log_cond: np.ndarray
    cumulative: np.ndarray  # within the source; the last edge's is infinite
    start: np.ndarray
    is_end: np.ndarray


def build_lattice(units: list[bytes], vocabulary: Vocabulary) -> Lattice:
    """All piece edges and backward log-sums of the units."""
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    start = np.concatenate(([0], np.cumsum(sizes + 1)))
    data = np.frombuffer(b"".join(x for u in units for x in (u, b"\0")), np.uint8)
    n = len(data)
    end_of = np.repeat(start[1:] - 1, sizes + 1)
    prefix = prefix_hashes(data)
    is_end = np.arange(n) == end_of
    head = (data & 0xC0) != 0x80
    alive = np.flatnonzero(~is_end & head)
    sources, targets, pieces = [], [], []
    length = 0
    while len(alive):
        length += 1
        alive = alive[alive + length <= end_of[alive]]
        if not len(alive):
            break
        h = span_hashes(prefix, alive, alive + length)
        hit, ids = vocabulary.prefixes.find(h)
        alive, ids = alive[hit], ids[hit]
        whole = ids >= 0
        sources.append(alive[whole])
        targets.append(alive[whole] + length)
        pieces.append(ids[whole])
    # characters that are no piece: byte edges all the way through them
    char_of = np.cumsum(head | is_end) - 1
    char_start = np.flatnonzero(head | is_end)
    char_end = np.append(char_start[1:], n)
    source, target, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sources, targets, pieces))
    known = np.zeros(len(char_start), bool)
    known[char_of[source[target == char_end[char_of[source]]]]] = True
    raw = np.flatnonzero(~is_end & ~known[char_of])
    source, target, piece = np.concatenate((source, raw)), np.concatenate((target, raw + 1)), np.concatenate((piece, vocabulary.byte_ids[data[raw]]))
    behind = end_of[source] - source
    order = np.argsort(behind * n + source)
    source, target, piece, behind = source[order], target[order], piece[order], behind[order]
    beta = np.full(n, -np.inf)
    beta[is_end] = 0.0
    log_prob = vocabulary.log_prob[piece]
    cuts = np.flatnonzero(np.diff(behind, prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(behind)), strict=True):  # nearest to the end first
        own = source[a:b]
        at = np.flatnonzero(np.diff(own, prepend=-1))
        beta[own[at]] = np.logaddexp.reduceat(log_prob[a:b] + beta[target[a:b]], at)
    log_cond = log_prob + beta[target] - beta[source]
    keep = np.isfinite(log_cond)
    source, target, piece, log_cond = source[keep], target[keep], piece[keep], log_cond[keep]
    falling = np.minimum(-log_cond * (1 << 20), (1 << 30) - 1).astype(np.int64)
    order = np.argsort((source << 30) | falling, kind="stable")  # a node's most probable edge first
    source, target, piece, log_cond = source[order], target[order], piece[order], log_cond[order]
    first = np.searchsorted(source, np.arange(n + 1))
    running = np.cumsum(np.exp(log_cond))
    inside = running - np.concatenate(([0.0], running))[first[source]]
    last = first[source + 1] - 1
    return Lattice(first, target, piece, log_cond, np.where(np.arange(len(last)) == last, np.inf, inside), start[:-1], is_end)


class LatticeCache:
    """The lattices of the units met so far in a task, in growing arrays; begun anew beyond `most_edges`."""

    def __init__(self, most_edges: int = MOST_EDGES) -> None:
        self.most_edges = most_edges
        self.clear()

    def clear(self) -> None:
        self.units = HashTable(1 << 15)
        self.n = self.edges = 0
        self.first, self.is_end = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, bool)
        self.target, self.piece, self.log_cond, self.cumulative = (np.zeros(1 << 17, t) for t in (np.int32, np.int32, np.float32, np.float32))

    def _room(self, name: str, size: int) -> np.ndarray:
        have = getattr(self, name)
        if len(have) < size:
            have = np.concatenate((have, np.zeros(max(size - len(have), len(have)), have.dtype)))
            setattr(self, name, have)
        return have

    def starts(self, joined_text: bytes, data: np.ndarray, at: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
        """The lattice position at which each unit of the text starts; new units are built and kept."""
        if self.edges > self.most_edges:
            self.clear()
        keys = span_hashes(prefix_hashes(data), at[:-1], at[1:]) | np.uint64(1)
        known, value = self.units.find(keys)
        if not known.all():
            new, first_seen = np.unique(keys[~known], return_index=True)
            index = np.flatnonzero(~known)[first_seen].tolist()
            built = build_lattice([joined_text[at[i] : at[i + 1]] for i in index], vocabulary)
            n, e = len(built.is_end), len(built.piece)
            self._room("first", self.n + n + 1)[self.n : self.n + n + 1] = built.first + self.edges
            self._room("is_end", self.n + n + 1)[self.n : self.n + n] = built.is_end
            self._room("target", self.edges + e)[self.edges : self.edges + e] = built.target + self.n
            for name in ("piece", "log_cond", "cumulative"):
                self._room(name, self.edges + e)[self.edges : self.edges + e] = getattr(built, name)
            self.units.add(new, built.start + self.n)
            self.n, self.edges = self.n + n, self.edges + e
            value = self.units.find(keys)[1]
        return value


def uniform(key: np.ndarray, part: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) from hashes of the key and the part."""
    with np.errstate(over="ignore"):
        key = mixed(key + np.asarray(part, np.uint64) * np.uint64(0xD1342543DE82EF95))
    return ((key >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32


@dataclass
class _Round:
    """Nodes of the completions sampled in one round, in order of (text, unit, step)."""

    text: np.ndarray
    unit: np.ndarray
    position: np.ndarray
    edge: np.ndarray
    key: np.ndarray


def _complete(lattice: LatticeCache, text_of: np.ndarray, token: np.ndarray, position: np.ndarray, key: np.ndarray) -> _Round:
    """Sample an edge at every node on the way from each token's position to its unit's end. key: one per token."""
    nodes, step = [], 0
    token, position = token.astype(np.int32), position.astype(np.int32)  # 4 bytes: a very long text has millions of nodes
    while len(token):
        u = uniform(key, step)
        pick = lattice.first[position]
        behind = np.flatnonzero(u > lattice.cumulative[pick])
        while len(behind):
            pick[behind] += 1
            behind = behind[u[behind] > lattice.cumulative[pick[behind]]]
        nodes.append((token, position, pick, key))
        position = lattice.target[pick]
        on = np.flatnonzero(~lattice.is_end[position])
        token, position, key = token[on], position[on], key[on]
        step += 1
    token, position, pick, key = (np.concatenate(c) for c in zip(*nodes, strict=True))
    order = np.argsort(token, kind="stable")  # steps stay in order
    token = token[order]
    return _Round(text_of[token].astype(np.int32), token, position[order], pick[order], key[order])


def _aside(lattice: LatticeCache, done: _Round, entry: np.ndarray, before: np.ndarray, own: np.ndarray, g: np.ndarray, nodes: np.ndarray, want: int) -> dict[int, list[tuple]]:
    """For each text the `want` best (value, node, edge, log-probability) among the children that the nodes left aside."""
    position = done.position[nodes]
    first = lattice.first[position].astype(np.int64)
    width = lattice.first[position + 1] - first
    cells = np.repeat(np.arange(len(nodes)), width)
    edge = np.arange(len(cells)) - np.repeat(np.cumsum(width) - width, width) + first[cells]
    aside = edge != done.edge[nodes[cells]]
    cells, edge = cells[aside], edge[aside]
    node = nodes[cells]
    child = before[node] + lattice.log_cond[edge]
    u = uniform(done.key[node], edge - first[cells] + 64 * (1 + position[cells] - entry[done.unit[node]]))
    owner = own[node]
    value = child - np.log(np.exp(child - g[owner]) - np.log(u))
    cuts = np.searchsorted(owner, np.arange(len(g) + 1))
    full = np.flatnonzero(np.diff(cuts))
    found: dict[int, list[tuple]] = {j: [] for j in range(len(g))}
    for _ in range(want if len(full) else 0):  # the largest of each text, then the next
        most = np.maximum.reduceat(value, cuts[full])
        at = np.flatnonzero((value == np.repeat(most, np.diff(cuts)[full])) & np.isfinite(value))
        for j, c in zip(owner[at].tolist(), at.tolist(), strict=True):
            found[j].append((float(value[c]), int(node[c]), int(edge[c]), float(child[c])))
        value[at] = -np.inf
    return found


def sample_texts(texts: list[bytes], keys: np.ndarray, vocabulary: Vocabulary, k: int = SAMPLES, lattice: LatticeCache | None = None) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text its up to k samples (ids, log_prob, inclusion score), best perturbed value first."""
    out: list[list[tuple[np.ndarray, float, float]]] = [[(np.zeros(0, np.int32), 0.0, 1.0)] if not t else [] for t in texts]
    some = [i for i, t in enumerate(texts) if t]
    if not some:
        return out
    bodies = [b" " + texts[i] for i in some]
    sizes = np.array([len(b) for b in bodies])
    text_start = np.cumsum(sizes) - sizes
    joined_text = b"".join(bodies)
    data = np.frombuffer(joined_text, np.uint8)
    at = unit_spans(data, text_start)
    lattice = lattice or LatticeCache()
    entry = lattice.starts(joined_text, data, at, vocabulary)
    text_of = np.searchsorted(text_start, at[:-1], side="right") - 1
    token_start = np.searchsorted(text_of, np.arange(len(some) + 1))
    key = mixed(np.asarray(keys, np.uint64)[some], 21)
    # state of each text's next path: where it leaves its parent, and the values there
    root = -np.log(-np.log(uniform(key, 0)))
    heaps: list[list[tuple]] = [[(-root[t], 0.0, -1, 0, int(token_start[t]), int(entry[token_start[t]]), -1)] for t in range(len(some))]
    paths: list[list[tuple]] = [[] for _ in some]
    for r in range(k):
        live = [t for t in range(len(some)) if heaps[t]]
        if not live:
            break
        taken = [heapq.heappop(heaps[t]) for t in live]
        g = np.array([-x[0] for x in taken])
        phi = np.array([x[1] for x in taken])
        begin = np.array([x[4] for x in taken])
        stop = token_start[np.array(live) + 1]
        counts = stop - begin
        token = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin, counts)
        position = entry[token].copy()
        head = (np.cumsum(counts) - counts)[counts > 0]
        position[head] = np.array([x[5] for x in taken])[counts > 0]
        if len(token):
            # a branch whose edge ended its unit goes on with the next unit, so a position is never a unit's end
            local = mixed(key[text_of[token]] + (token - token_start[text_of[token]]).astype(np.uint64), r + 1)
            done = _complete(lattice, text_of, token, position, local)
        else:
            none = np.zeros(0, np.int64)
            done = _Round(none, none, none, none, none.astype(np.uint64))
        slot = np.full(len(some), -1)
        slot[live] = np.arange(len(live))
        own = slot[done.text]
        n_nodes = np.bincount(own, minlength=len(live))
        node_start = np.cumsum(n_nodes) - n_nodes
        cond = lattice.log_cond[done.edge].astype(np.float64)
        running = np.cumsum(cond)
        before = running - cond - np.repeat((np.concatenate(([0.0], running))[node_start]), n_nodes) + np.repeat(phi, n_nodes)
        total = np.bincount(own, cond, len(live)) + phi
        for j, t in enumerate(live):
            a = node_start[j]
            ids = lattice.piece[done.edge[a : a + n_nodes[j]]].astype(np.int32)
            _, _, parent, keep, _, _, lead = taken[j]
            if parent >= 0:
                ids = np.concatenate((paths[t][parent][0][:keep], np.array([lead], np.int32), ids))
            paths[t].append((ids, float(total[j]), float(g[j]), keep + (parent >= 0)))
        # Children left aside, with their truncated Gumbel values. Noise adds at most NOISE to a log-probability, and the
        # path's falls from node to node, so nodes far below the values found can hold no better child.
        want = k - r
        near = before >= phi[own] - NOISE - MARGIN
        found = _aside(lattice, done, entry, before, own, g, np.flatnonzero(near), want)
        short = np.array([len(found[j]) < want or found[j][-1][0] < phi[j] - MARGIN for j in range(len(live))], bool)
        short &= np.bincount(own[~near], minlength=len(live)) > 0
        if short.any():
            again = _aside(lattice, done, entry, before, own, g, np.flatnonzero(short[own]), want)
            found.update((j, again[j]) for j in np.flatnonzero(short).tolist())
        for j, t in enumerate(live):
            for value, node, e, child in found[j]:
                target = int(lattice.target[e])
                token_at = int(done.unit[node])
                if lattice.is_end[target]:
                    token_at += 1
                    target = int(entry[token_at]) if token_at < token_start[t + 1] else -1
                keep = paths[t][-1][3] + node - int(node_start[j])
                heapq.heappush(heaps[t], (-value, child, len(paths[t]) - 1, keep, token_at, target, int(lattice.piece[e])))
    for t, i in enumerate(some):
        kappa = -heaps[t][0][0] if heaps[t] else None
        out[i] = [(ids, lp, 1.0 if kappa is None else float(-np.expm1(-np.exp(min(lp - kappa, 50.0))))) for ids, lp, _, _ in paths[t]]
    return out


def joined_pieces(ids: np.ndarray, vocabulary: Vocabulary) -> tuple[bytes, np.ndarray]:
    """The pieces' bytes in a row, and the offset behind each piece. Works in blocks of DECODED ids, whatever a text's length."""
    size = vocabulary.size[ids]
    out = []
    for at in range(0, len(ids), DECODED):
        own = size[at : at + DECODED]
        end = np.cumsum(own)
        out.append(vocabulary.data[np.repeat(vocabulary.start[ids[at : at + DECODED]] - end + own, own) + np.arange(int(end[-1]))].tobytes())
    return b"".join(out), np.cumsum(size)


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> bytes:
    """The text's bytes: the pieces joined, without the blank that encoding put in front."""
    return joined_pieces(ids, vocabulary)[0][1:]


def encode_samples(documents: DataFrame, model: str, k: int = SAMPLES, seed: int = 0, most_edges: int = MOST_EDGES) -> DataFrame:
    """(doc_id, sample, ids, n_pieces, log_prob, inclusion, round_trip).

    Up to k rows per document, sample 1 .. k by falling perturbed value; fewer where the lattice has fewer paths. Null
    and empty texts have one sample without pieces. The row key is doc_id (null: 0), so repeated rows get equal samples.
    An empty table gives an empty result; other columns are ignored. `model` is the path of a SentencePiece file, read by
    the driver. Equal perturbed values, which need equal hashes, are taken in the order of their nodes.
    `most_edges` bounds the lattices that a task keeps, some 30 bytes each; it changes time and memory, no result.
    """
    spark: SparkSession = documents.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(model))  # the vocabulary file's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, lattice = shared.value, LatticeCache(most_edges)
        for batch, texts in chunks(batches, most=1 << 18):
            doc_id = batch.column(batch.schema.get_field_index("doc_id"))
            keys = mixed(np.array(doc_id.fill_null(0).to_pylist(), np.int64).view(np.uint64), seed)
            rows = []
            for i, samples in enumerate(sample_texts(texts, keys, vocabulary, k, lattice)):
                for rank, (ids, log_prob, inclusion) in enumerate(samples, 1):
                    rows.append((i, rank, ids, len(ids), log_prob, inclusion))
            index, *columns = zip(*rows)
            offsets = np.concatenate(([0], np.cumsum(columns[2])))
            ids = np.concatenate(columns[1])
            back, end = joined_pieces(ids, vocabulary)
            cuts = np.concatenate(([0], end))[offsets].tolist()
            columns.append([back[a + 1 : b] == texts[i] for i, a, b in zip(index, cuts, cuts[1:], strict=False)])
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            made = [doc_id.take(pa.array(index)), pa.array(columns[0], pa.int32()), lists, *(pa.array(c, t) for c, t in zip(columns[2:], (pa.int64(), pa.float64(), pa.float64(), pa.bool_()), strict=True))]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "sample", "ids", "n_pieces", "log_prob", "inclusion", "round_trip"])

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, sample int, ids array<int>, n_pieces long, log_prob double, inclusion double, round_trip boolean")
