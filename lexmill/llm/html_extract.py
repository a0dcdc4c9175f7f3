"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks. Each becomes a vector: its tag path (tags, and words of classes and
ids, hashed), its words (hashed), and its shape (length, share of links, marks, digits and capitals,
place in the page). A bidirectional LSTM in numpy reads the sequence of a whole page both ways, so
the label of every block (main text or not) rests on the page around it. The labeller is trained
at first use, on made-up pages from a fixed seed, and broadcast; its size is fixed.

The main text is the blocks labelled so, in page order, joined by an empty line.

Defined results: a null or empty page, or one without main text, gives an empty text; a page of any
length is read whole, in time proportional to it; ids keep their type; rows with null or repeated ids return as often as they come; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import spread, table
from lexmill.llm.html_blocks import NAME_DIMS, TAG_DIMS, Block, Path, blocks_of, hashed
from lexmill.llm.html_pages import pages
from lexmill.session import ship

PARENT_DIMS, WORD_DIMS, SHAPE_DIMS = 48, 48, 10
DIMS = TAG_DIMS + NAME_DIMS + PARENT_DIMS + WORD_DIMS + SHAPE_DIMS
HIDDEN, SEED = 20, 7
TRAIN_PAGES, EPOCHS, BATCH, RATE = 3000, 8, 50, 0.01
#: Blocks (padding counted) that are labelled at once; a longer page is read in stretches that hand on their states.
MOST = 20_000
_TERMS = re.compile(r"[^\W\d_]+")
_MARKS = re.compile(r"[^\w\s]")
_NONE = np.empty(0, np.int64)


def path_vector(path: Path) -> np.ndarray:
    """The part of a block's vector that its tag path gives; blocks of a page share few paths."""
    v = np.zeros(TAG_DIMS + NAME_DIMS + PARENT_DIMS, np.float32)
    bits = (path.tags | path.names << TAG_DIMS).to_bytes((TAG_DIMS + NAME_DIMS) // 8, "little")
    v[: TAG_DIMS + NAME_DIMS] = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
    if path.tag:
        v[[TAG_DIMS + NAME_DIMS + hashed(t, PARENT_DIMS) for t in (f"<{path.tag}", *(f".{n}" for n in path.own))]] = 1
    return v


#: A character's kind (mark, digit, capital), each a count in its own 20 bits of a sum; -1 until it is met.
_KINDS = np.full(0x110000, -1, np.int64)
#: Characters whose kinds are counted at once.
PIECE = (1 << 20) - 1


def kinds(texts: list[str]) -> np.ndarray:
    """How many marks, digits and capitals each of the texts has; none may be empty."""
    sizes = [*map(len, texts)]
    if sum(sizes) > PIECE:
        if len(texts) == 1:
            return kinds([texts[0][a : a + PIECE] for a in range(0, sizes[0], PIECE)]).sum(0, keepdims=True)
        half = len(texts) // 2
        return np.concatenate([kinds(texts[:half]), kinds(texts[half:])])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    found = _KINDS[codes]
    if (new := codes[found < 0]).size:
        for code in set(new.tolist()):
            c = chr(code)
            _KINDS[code] = bool(_MARKS.match(c)) | c.isdigit() << 20 | c.isupper() << 40
        found = _KINDS[codes]
    sums = np.add.reduceat(found, np.cumsum([0, *sizes[:-1]]))
    return np.stack([sums & PIECE, sums >> 20 & PIECE, sums >> 40], 1)


def text_vectors(blocks: list[Block], before: int, n: int) -> np.ndarray:
    """The part of the blocks' vectors that their texts and places give."""
    texts, m = [b.text for b in blocks], len(blocks)
    words = np.empty((m, WORD_DIMS))
    for i, text in enumerate(texts):
        words[i] = np.bincount([crc32(w.encode()) % WORD_DIMS for w in _TERMS.findall(text.lower())] or _NONE, minlength=WORD_DIMS)
    terms = words.sum(1)
    size = np.array([*map(len, texts)], float)
    marks, digits, capitals = kinds(texts).T / size
    place = (before + np.arange(m) + 0.5) / n
    shape = (
        np.log1p(size) / 8, np.log1p(terms) / 6, np.array([b.linked for b in blocks]) / size, np.minimum(1, 4 * marks), digits,
        capitals, place, 1 - place, np.full(m, np.log1p(n) / 6), np.ones(m),
    )
    return np.concatenate([np.log1p(words) / np.log1p(np.maximum(terms, 1))[:, None], np.stack(shape, 1)], 1)


def vectors(blocks: list[Block], seen: dict | None = None, before: int = 0, n: int | None = None) -> np.ndarray:
    """A vector per block of a page, or of a stretch of it that has so many blocks before it, of n."""
    seen = {} if seen is None else seen
    out = np.empty((len(blocks), DIMS), np.float32)
    for i, b in enumerate(blocks):
        if (p := seen.get(b.path)) is None:
            if len(seen) > 50_000:
                seen.clear()
            p = seen[b.path] = path_vector(b.path)
        out[i, : len(p)] = p
    out[:, len(p) :] = text_vectors(blocks, before, len(blocks) if n is None else n)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction: weights of input, state and bias for the gates (in, forget, out, new)."""

    def __init__(self, rng: np.random.Generator):
        self.w = (rng.standard_normal((DIMS, 4 * HIDDEN)) / np.sqrt(DIMS)).astype(np.float32)
        self.u = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
        self.b = np.zeros(4 * HIDDEN, np.float32)
        self.b[HIDDEN : 2 * HIDDEN] = 1

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False, state: list | None = None):
        """States (time, page, HIDDEN) of x (time, page, DIMS); a masked step leaves the state as it was.

        state: what a stretch before this one left, replaced by what this one leaves.
        """
        steps, n, _ = x.shape
        z = x @ self.w + self.b
        h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        out, held = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps):
            a = z[t] + h @ self.u
            s, g = _sigmoid(a[:, : 3 * HIDDEN]), np.tanh(a[:, 3 * HIDDEN :])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            new = f * c + i * g
            tc, m = np.tanh(new), mask[t][:, None]
            if keep:
                held.append((h, c, i, f, o, g, tc))
            c = m * new + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            out[t] = h
        if state is not None:
            state[:] = h, c
        return out, held

    def back(self, x: np.ndarray, mask: np.ndarray, held: list, dout: np.ndarray):
        """Gradients of w, u and b."""
        dz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        du, dh, dc = np.zeros_like(self.u), np.zeros_like(dout[0]), np.zeros_like(dout[0])
        for t in range(len(x) - 1, -1, -1):
            h, c, i, f, o, g, tc = held[t]
            m = mask[t][:, None]
            dh = dh + dout[t]
            live, dnew = dh * m, dc * m
            dnew = dnew + live * o * (1 - tc * tc)
            da = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), live * tc * o * (1 - o), dnew * i * (1 - g * g)], 1)
            dz[t] = da
            du += h.T @ da
            dh = dh * (1 - m) + da @ self.u.T
            dc = dc * (1 - m) + dnew * f
        flat = dz.reshape(-1, 4 * HIDDEN)
        return x.reshape(-1, DIMS).T @ flat, du, flat.sum(0)


class Labeller:
    """Two LSTMs, one for each direction, and a logistic layer over both states of a block."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.ways = [Lstm(rng), Lstm(rng)]
        self.v = (rng.standard_normal(2 * HIDDEN) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    @staticmethod
    def padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(map(len, xs))
        x, mask = np.zeros((steps, len(xs), DIMS), np.float32), np.zeros((steps, len(xs)), np.float32)
        for k, v in enumerate(xs):
            x[: len(v), k], mask[: len(v), k] = v, 1
        return x, mask

    def chances(self, xs: list[np.ndarray]) -> list[np.ndarray]:
        """For each page (a vector per block) the probability of each block to be main text."""
        x, mask = self.padded(xs)
        ahead, _ = self.ways[0].run(x, mask)
        back, _ = self.ways[1].run(x[::-1], mask[::-1])
        p = _sigmoid(ahead @ self.v[:HIDDEN] + back[::-1] @ self.v[HIDDEN:] + self.c)
        return [p[: len(v), k] for k, v in enumerate(xs)]

    def chances_of_long(self, blocks: list[Block], seen: dict | None = None, stretch: int = MOST) -> np.ndarray:
        """The same for one page of any length, in stretches: only a number per block is held besides the blocks."""
        n, z = len(blocks), np.zeros(len(blocks), np.float32)
        starts = range(0, n, stretch)
        for way, order, v in ((0, starts, self.v[:HIDDEN]), (1, reversed(starts), self.v[HIDDEN:])):
            state: list = []
            for a in order:
                x = vectors(blocks[a : a + stretch], seen, a, n)[:: -1 if way else 1, None]
                out, _ = self.ways[way].run(x, np.ones(x.shape[:2], np.float32), state=state)
                z[a : a + stretch] += (out[:, 0] @ v)[:: -1 if way else 1]
        return _sigmoid(z + self.c)

    def parameters(self) -> list[np.ndarray]:
        return [p for w in self.ways for p in (w.w, w.u, w.b)] + [self.v, self.c]

    def gradients(self, xs: list[np.ndarray], ys: list[np.ndarray]) -> list[np.ndarray]:
        x, mask = self.padded(xs)
        y = np.zeros_like(mask)
        for k, v in enumerate(ys):
            y[: len(v), k] = v
        ahead, held = self.ways[0].run(x, mask, True)
        back, held_back = self.ways[1].run(x[::-1], mask[::-1], True)
        back = back[::-1]
        d = (_sigmoid(ahead @ self.v[:HIDDEN] + back @ self.v[HIDDEN:] + self.c) - y) * mask / mask.sum()
        dv = np.concatenate([np.tensordot(d, ahead, 2), np.tensordot(d, back, 2)])
        g = [*self.ways[0].back(x, mask, held, d[..., None] * self.v[:HIDDEN])]
        g += self.ways[1].back(x[::-1], mask[::-1], held_back, (d[..., None] * self.v[HIDDEN:])[::-1])
        return [*g, dv, d.sum(keepdims=True).reshape(1)]

    def train(self, data: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> None:
        """Adam over batches of pages of like length."""
        rng, ps = np.random.default_rng(seed), self.parameters()
        ms, vs, step = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps], 0
        data = sorted(data, key=lambda xy: len(xy[0]))
        groups = [data[a : a + BATCH] for a in range(0, len(data), BATCH)]
        for epoch in range(epochs):
            for k in rng.permutation(len(groups)):
                step += 1
                for p, m, v, g in zip(ps, ms, vs, self.gradients(*map(list, zip(*groups[k], strict=True))), strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * 0.5**epoch * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def training_data(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of made-up pages; a block's label is that of its first run."""
    out = []
    for page in pages(n, seed):
        marked = blocks_of(page)
        clean = [b._replace(text=re.sub("\x01[01]", "", b.text)) for b in marked]
        pairs = [(b, int(m.text[m.text.index("\x01") + 1])) for b, m in zip(clean, marked, strict=True) if b.text and "\x01" in m.text]
        if pairs:
            out.append((vectors([b for b, _ in pairs]), np.array([y for _, y in pairs], np.float32)))
    return out


_trained: dict = {}


def labeller(n: int = TRAIN_PAGES, seed: int = SEED) -> Labeller:
    """The labeller, trained at first use in this process."""
    if (n, seed) not in _trained:
        made = Labeller(seed)
        made.train(training_data(n, seed))
        _trained[n, seed] = made
    return _trained[n, seed]


def main_texts(htmls: list[str | None], model: Labeller, seen: dict | None = None) -> list[str]:
    """The main text of each page."""
    out, read = [""] * len(htmls), [blocks_of(h) for h in htmls]
    order = sorted((k for k, b in enumerate(read) if b), key=lambda k: len(read[k]))
    while order:
        n = len(read[order[0]])
        take = 1
        while take < len(order) and take < 512 and len(read[order[take]]) * (take + 1) <= max(MOST, n):
            take += 1
        group, order = order[:take], order[take:]
        if n > MOST:
            found = [model.chances_of_long(read[k], seen) for k in group]
        else:
            found = model.chances([vectors(read[k], seen) for k in group])
        for k, p in zip(group, found, strict=True):
            out[k] = "\n\n".join(b.text for b, chance in zip(read[k], p, strict=True) if chance >= 0.5)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Labeller | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model or labeller())

    def run(batches):
        import pyarrow as pa

        seen: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = main_texts(part.column(2).to_pylist(), held.value, seen)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string"))
    schema = T.StructType([*chosen.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return chosen.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
