"""Secret scans: fixed patterns, and a convolutional network over every other candidate.

One pass over the texts finds the spans of the patterns, and as candidates all other
runs of at least ``LEAST`` letters, digits and + / _ . -, each with the bytes around it.
Findings of the patterns are the labelled secrets, candidates apart from them the
labelled rest.  A finding is shown without the key in front of it, as those are that the
patterns miss.  The network sees a candidate with its surroundings as characters, each
told apart by whether it stands before, inside or after; filters of five characters run
over all of it, and the largest answer of each goes through one hidden layer.

The network is trained on a bounded sample of documents outside the held-out fold.  All
else covers all data: every candidate is scored, the scores of all held-out rows are
calibrated, and per shape of candidate (small hex, capitals and digits, other) the
threshold is the highest that keeps ``RECALL`` of all held-out findings of that shape.
Candidates that reach it become spans of the kind ``learned``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import stored
from rulewright.llm.textbytes import slices

# The patterns, the least length of what each must find, and the kinds in order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KINDS = ("assign", "access", "hex")
LEARNED = "learned"
# Fixed value: what a text with an assignment holds, whatever its case.
HINT = re.compile(rb"password|passwd|secret|token|api_?key", re.IGNORECASE)

LEAST = 12
BEFORE, AFTER = 24, 8
#: At most so many findings, and twice as many other candidates, train the network.
SAMPLE = 3000
HELD_OUT = 5
RECALL = 0.95
#: Held-out findings that a shape needs for a threshold of its own.
ENOUGH = 20
BINS_PER_UNIT, BIN_LIMIT = 16, 640

WIDTH, FILTERS, HIDDEN = 5, 32, 16
SYMBOLS = 98  # printable ASCII, other ASCII, beyond ASCII, nothing
BATCH, EPOCHS, STEP = 128, 5, 3e-3
POSITIONS = 1 << 17

_SYMBOL = np.full(256, 96, np.int64)
_SYMBOL[:128] = 95
_SYMBOL[32:127] = np.arange(95)
_NOTHING = 97
_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.-"]] = True
_SMALL_HEX = np.zeros(256, bool)
_SMALL_HEX[[ord(c) for c in "0123456789abcdef"]] = True


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; no run crosses a text's edge."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[at] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, where the secret itself starts) of the patterns, in order."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(found)


def shape_of(secret: bytes) -> int:
    """0: digits and a-f; 1: digits and A-Z; 2: other."""
    s = secret.decode("ascii", "replace")
    if all(c in "0123456789abcdef" for c in s):
        return 0
    return 1 if all(c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in s) else 2


SCANNED = (
    "doc_id long, fold int, base array<struct<start:int,kind:int,end:int>>, "
    "open array<struct<start:int,end:int,secret:boolean,shape:int,view:binary,before:int,after:int>>"
)


def scan(docs: DataFrame) -> DataFrame:
    """Rows of ``SCANNED``: per document the spans of the patterns and, with their surroundings,
    the secrets in them and the other candidates.  Places are code points, views are bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j], batch.column("fold")[i:j], *_scan_slice(data, at)], ["doc_id", "fold", "base", "open"]
                )

    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(HELD_OUT)).cast("int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", fold.alias("fold")).mapInArrow(run, SCANNED)


def _scan_slice(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
    body, n = data.tobytes(), len(at) - 1
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    # Texts in which a pattern can match at all.
    places = [m.start() for m in HINT.finditer(body)] + [m.start() for m in re.finditer(rb"AKIA", body)]
    starts, ends = runs(_SMALL_HEX[data], at)
    places = np.concatenate([np.array(places, np.int64), starts[ends - starts >= HEX_LEAST]])
    rows = np.unique(np.searchsorted(at, places, "right") - 1).tolist()
    base: list[list[dict]] = [[] for _ in range(n)]
    taken, secrets = [], {}
    for r in rows:
        text = body[at[r] : at[r + 1]].decode()
        found = base_spans(text)
        base[r] = [{"start": a, "kind": k, "end": b} for a, k, b, _ in found]
        # Code points to bytes of this text.
        spots = at[r] + np.append(np.flatnonzero((data[at[r] : at[r + 1]] & 0xC0) != 0x80), at[r + 1] - at[r])
        taken += [(int(spots[a]), int(spots[b])) for a, _, b, _ in found]
        for a, _, b, s in found:
            place = int(spots[s]), int(spots[b])
            secrets[place] = min(int(spots[a]), secrets.get(place, place[0]))
    starts, ends = runs(_RUN[data], at)
    long = ends - starts >= LEAST
    starts, ends = starts[long], ends[long]
    if taken:
        a, b = np.array(sorted(taken)).T
        reach = np.maximum.accumulate(b)
        last = np.searchsorted(a, ends) - 1  # the last span that begins before the run ends
        apart = (last < 0) | (reach[last] <= starts)
        starts, ends = starts[apart], ends[apart]
    # (start, end, where what stands before it ends, whether it is a secret)
    spans = [(x, y, x, False) for x, y in zip(starts.tolist(), ends.tolist())] + [(x, y, a, True) for (x, y), a in secrets.items()]
    spans.sort()
    owner = np.searchsorted(at, np.array([x for x, *_ in spans], np.int64), "right") - 1
    entries: list[list[dict]] = [[] for _ in range(n)]
    for (x, y, edge, secret), r in zip(spans, owner.tolist()):
        low, high = max(edge - BEFORE, int(at[r])), min(y + AFTER, int(at[r + 1]))
        entries[r].append({
            "start": int(points[x] - points[at[r]]), "end": int(points[y] - points[at[r]]), "secret": secret,
            "shape": shape_of(body[x:y]), "view": body[low:edge] + body[x:high], "before": edge - low, "after": high - y,
        })
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    entry = pa.struct([
        ("start", pa.int32()), ("end", pa.int32()), ("secret", pa.bool_()), ("shape", pa.int32()),
        ("view", pa.binary()), ("before", pa.int32()), ("after", pa.int32()),
    ])
    return pa.array(base, pa.list_(span)), pa.array(entries, pa.list_(entry))


def symbols(view: bytes, before: int, after: int) -> np.ndarray:
    """The characters of a view, each with its zone, between edges of nothing."""
    s = np.full(len(view) + WIDTH - 1, _NOTHING, np.int64)
    inner = s[WIDTH // 2 : len(view) + WIDTH // 2]
    inner[:] = _SYMBOL[np.frombuffer(view, np.uint8)]
    inner[before : len(view) - after] += SYMBOLS
    inner[len(view) - after :] += SYMBOLS
    inner[len(view) - after :] += SYMBOLS
    return s


@dataclass
class Network:
    """Weights of the network; the first layer is one table per place of a filter."""

    table: np.ndarray  # WIDTH x (3 * SYMBOLS) x FILTERS
    shift: np.ndarray
    hidden: np.ndarray  # FILTERS x HIDDEN
    hidden_shift: np.ndarray
    last: np.ndarray
    last_shift: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 1) -> Network:
        rnd = np.random.default_rng(seed)
        return cls(
            rnd.normal(0, 0.15, (WIDTH, 3 * SYMBOLS, FILTERS)), np.zeros(FILTERS),
            rnd.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)), np.zeros(HIDDEN), rnd.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1),
        )

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.table, self.shift, self.hidden, self.hidden_shift, self.last, self.last_shift]

    def answers(self, flat: np.ndarray, place: np.ndarray) -> np.ndarray:
        """What each filter answers at each place (no less than zero)."""
        out = self.table[0][flat[place]] + self.shift
        for k in range(1, WIDTH):
            out += self.table[k][flat[place + k]]
        return np.maximum(out, 0, out=out)

    def pooled(self, views: list[np.ndarray]) -> np.ndarray:
        """The largest answer of each filter over all of each view, ``POSITIONS`` places at a time."""
        sizes = np.array([len(v) - WIDTH + 1 for v in views], np.int64)
        flat = np.concatenate(views)
        of = np.repeat(np.arange(len(views)), sizes)
        place = np.arange(len(of)) + of * (WIDTH - 1)
        out = np.zeros((len(views), FILTERS))
        for x in range(0, len(of), POSITIONS):
            some = of[x : x + POSITIONS]
            first = np.flatnonzero(np.append(True, some[1:] != some[:-1]))
            top = np.maximum.reduceat(self.answers(flat, place[x : x + POSITIONS]), first, axis=0)
            out[some[first]] = np.maximum(out[some[first]], top)
        return out

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(pooled @ self.hidden + self.hidden_shift, 0)
        return hidden, hidden @ self.last + self.last_shift[0]

    def logits(self, views: list[np.ndarray]) -> np.ndarray:
        return self.head(self.pooled(views))[1] if views else np.zeros(0)

    def slopes(self, views: list[np.ndarray], truth: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean logistic loss, and its slope in every weight."""
        sizes = np.array([len(v) - WIDTH + 1 for v in views], np.int64)
        flat = np.concatenate(views)
        of = np.repeat(np.arange(len(views)), sizes)
        place = np.arange(len(of)) + of * (WIDTH - 1)
        answers = self.answers(flat, place)
        pooled = np.maximum.reduceat(answers, np.cumsum(sizes) - sizes, axis=0)
        hidden, logit = self.head(pooled)
        loss = float(np.mean(np.logaddexp(0, logit) - truth * logit))
        d_logit = (0.5 * (1 + np.tanh(logit / 2)) - truth) / len(views)
        d_hidden = d_logit[:, None] * self.last * (hidden > 0)
        d_pooled = (d_hidden @ self.hidden.T) * (pooled > 0)
        # The first place with the largest answer has caused it.
        spot, channel = np.nonzero((answers == pooled[of]) & (d_pooled[of] != 0))
        _, one = np.unique(of[spot] * FILTERS + channel, return_index=True)
        spot, channel = spot[one], channel[one]
        value = d_pooled[of[spot], channel]
        table = np.zeros_like(self.table)
        for k in range(WIDTH):
            np.add.at(table[k], (flat[place[spot] + k], channel), value)
        return loss, [table, np.bincount(channel, value, FILTERS), pooled.T @ d_hidden, d_hidden.sum(0), hidden.T @ d_logit, np.array([d_logit.sum()])]


def trained(views: list[np.ndarray], truth: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Network:
    """A network fitted by Adam in batches; both classes weigh what they hold."""
    net, rnd = Network.fresh(seed), np.random.default_rng(seed + 1)
    means = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights]
    turn = 0
    for _ in range(epochs):
        order = rnd.permutation(len(views))
        for x in range(0, len(order), BATCH):
            some = order[x : x + BATCH]
            turn += 1
            _, slopes = net.slopes([views[k] for k in some], truth[some])
            for w, (m, v), g in zip(net.weights, means, slopes):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= STEP * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return net


def training_rows(scanned: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Views and classes of at most ``SAMPLE`` findings and twice as many other candidates outside the
    held-out fold, in the order of a hash."""
    each = scanned.where(F.col("fold") != 0).select("doc_id", F.explode("open").alias("e")).select("doc_id", "e.*")
    counts = {r.secret: r.n for r in each.groupBy("secret").agg(F.count("*").alias("n")).collect()}
    views: list[np.ndarray] = []
    truth: list[float] = []
    for secret, most in ((True, SAMPLE), (False, 2 * SAMPLE)):
        # Twice as many hashes as are wanted, so that no task sends more than its part of them.
        share = min(1.0, 2 * most / max(counts.get(secret, 0), 1))
        spot = F.xxhash64("view", "doc_id", "start")
        drawn = each.where((F.col("secret") == secret) & (spot <= int(-(2**63) + share * (2**64 - 2048))))
        for r in drawn.orderBy(spot, "view", "start").limit(most).select("view", "before", "after").collect():
            views.append(symbols(bytes(r.view), r.before, r.after))
            truth.append(float(secret))
    return views, np.array(truth)


SCORED = "doc_id long, fold int, base array<struct<start:int,kind:int,end:int>>, open array<struct<start:int,end:int,secret:boolean,shape:int,logit:double>>"


def scored(scanned: DataFrame, net: Network | None) -> DataFrame:
    """``scanned`` with the network's logit of every entry instead of its view; NULL without a network."""
    known = scanned.sparkSession.sparkContext.broadcast(net)
    entry = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("secret", pa.bool_()), ("shape", pa.int32()), ("logit", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("open")
            flat = column.flatten()
            logits = np.full(len(flat), np.nan)
            if known.value is not None:
                lot, held, first = [], 0, 0
                for k, (view, before, after) in enumerate(zip(flat.field("view"), flat.field("before").to_pylist(), flat.field("after").to_pylist())):
                    lot.append(symbols(view.as_py(), before, after))
                    held += len(lot[-1])
                    if held >= POSITIONS or k == len(flat) - 1:
                        logits[first : k + 1] = known.value.logits(lot)
                        lot, held, first = [], 0, k + 1
            values = pa.StructArray.from_arrays(
                [*(flat.field(c) for c in ("start", "end", "secret", "shape")), pa.array(logits, mask=np.isnan(logits))], fields=list(entry)
            )
            edges = np.append(0, np.cumsum(np.asarray(column.value_lengths())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("fold"), batch.column("base"), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)],
                ["doc_id", "fold", "base", "open"],
            )

    return scanned.mapInArrow(run, SCORED)


def calibrated(logit: np.ndarray, secret: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits ``n`` rows per logit and class best (Platt)."""
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 0.5 * (1 + np.tanh((slope * logit + shift) / 2))
        d = n * (p - secret)
        w = n * np.maximum(p * (1 - p), 1e-9)
        curve = np.array([[np.sum(w * logit**2) + 1e-3, np.sum(w * logit)], [np.sum(w * logit), np.sum(w) + 1e-3]])
        step = np.linalg.solve(curve, [np.sum(d * logit) + 1e-3 * (slope - 1), np.sum(d) + 1e-3 * shift])
        step *= min(1.0, 2 / max(np.abs(step).max(), 1e-12))
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(slope, 1e-6)), float(shift)


def thresholds(table: DataFrame) -> tuple[tuple[float, float], dict[int, float]]:
    """The calibration, and per shape the calibrated probability that a candidate must reach.

    It comes from the numbers of all held-out rows per class, shape and step of the logit.
    """
    step = F.greatest(F.lit(-BIN_LIMIT), F.least(F.lit(BIN_LIMIT), F.floor(F.col("e.logit") * BINS_PER_UNIT))).cast("int")
    held_out = table.where(F.col("fold") == 0).select(F.explode("open").alias("e")).where("e.logit IS NOT NULL")
    rows = held_out.groupBy("e.secret", "e.shape", step.alias("step")).agg(F.count("*").alias("n")).collect()
    if not any(r.secret for r in rows):
        return (1.0, 0.0), {}
    middle = np.array([(r.step + 0.5) / BINS_PER_UNIT for r in rows])
    fit = calibrated(middle, np.array([float(r.secret) for r in rows]), np.array([r.n for r in rows], float))

    def kept(shapes: set[int]) -> float | None:
        mine = sorted(((r.step, r.n) for r in rows if r.secret and r.shape in shapes), reverse=True)
        total, above = sum(n for _, n in mine), 0
        if total < (ENOUGH if len(shapes) == 1 else 1):
            return None
        for at, n in mine:
            above += n
            if above >= RECALL * total:
                return probability(at / BINS_PER_UNIT, fit)
        return None

    every = kept({0, 1, 2})
    return fit, {s: every if (own := kept({s})) is None else own for s in range(3)}


def probability(logit: float, fit: tuple[float, float]) -> float:
    return float(0.5 * (1 + np.tanh((fit[0] * logit + fit[1]) / 2)))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of ``docs``.

    Spans are kind:start:end in code points, end exclusive, ordered by start, then kind.
    Texts that are NULL or empty have no spans.  Every row is a document of its own, also
    with a repeated or NULL doc_id.  Other columns are not read.  An empty table gives no
    rows.  Where no document outside the held-out fold has a finding, or none in it, or
    there are no other candidates to tell them from, nothing is learned and only the
    patterns count.  Texts and candidates of any length are read whole.
    """
    scanned = stored(scan(docs), "secret-candidates")
    views, truth = training_rows(scanned)
    net = trained(views, truth) if 0 < truth.sum() < len(truth) else None
    table = stored(scored(scanned, net), "secret-scores")
    fit, least = thresholds(table)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, entries in zip(batch.column("base").to_pylist(), batch.column("open").to_pylist()):
                spans = [(b["start"], b["kind"], b["end"]) for b in base]
                more = [
                    (e["start"], len(KINDS), e["end"])
                    for e in entries
                    if not e["secret"] and e["logit"] is not None and e["shape"] in least and probability(e["logit"], fit) >= least[e["shape"]]
                ]
                counts = [sum(k == kind for _, k, _ in spans) for kind in range(len(KINDS))]
                out.append((*counts, hashlib.sha256(written(spans).encode()).hexdigest(), written(sorted(spans + more))))
            *counts, sha, spans = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return table.mapInArrow(finish, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def written(spans: list[tuple[int, int, int]]) -> str:
    names = (*KINDS, LEARNED)
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
