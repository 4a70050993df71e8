"""Toxicity: convolutional text classifier on hashed word embeddings.

A word's embedding is the sum of the rows of three hashes: the word and its
first 4 and 5 bytes, so that inflected forms share what was learned. Hashes go to
``2**BITS`` buckets; a bucket belongs to the feature that most training texts
had in it, known by 14 further bits of its hash, and every other feature uses a
row of zeros: words that training has not seen cannot collide with those it has.
Filters of several widths run over the words, each text keeps their maxima,
and a logistic layer with weights of 0 or more turns them into a score: words can
only add to it, so an empty text has the lowest. All of it is trained in numpy
on every labelled row. Up to ``PIECE_ROWS`` rows are trained on the driver. More are
dealt into pieces of about as many: in each epoch every piece trains by itself from the
same state, and each row of the state moves by the mean of the pieces that moved it.
Sums are of whole numbers, so the model depends neither on tasks nor on their order.

Thresholds are calibrated by language: a naive Bayes model over the same word rows
guesses the language from the text itself, and each language has its own cut,
found on the fifth of the labelled rows that training leaves out. Scores are shifted so
that the cut is at 0.5.

Edge cases: a null or empty text has no words and gets the score of an empty
window. Null labels and labels without a document are not used; without both
classes every score is 0. Rows that repeat a doc_id are scored each. Texts of
any length are read whole. Only doc_id, text and, for labelled rows, lang are read,
so extra columns do not matter; a null lang counts as a language of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import batches, labelled_rows
from .shared import Tokens, stored

BITS = 18
HEADS = (4, 5)
WIDTHS = (1, 2, 3)
SIZE, FILTERS = 8, 5  # embedding length; filters of each width
PIECE_ROWS = 5000  # labelled rows that are trained in one go
PIECE_BYTES = 1 << 26  # of their words; a piece with more rows or bytes is cut
MIN_TEXTS = 3  # training texts that must have a feature for it to own its bucket
EPOCHS = 5
SEED = 7
UNIT = 2.0**32  # changes of the state are summed as whole numbers of its inverse
PIECE = 1 << 20  # bytes of text that are scored at a time


@dataclass
class Model:
    row_of: np.ndarray  # bucket -> row, 0 for none
    tag: np.ndarray  # bucket -> further bits of its owner
    table: np.ndarray  # row x all filters' offsets: the embedding times the filters
    shift: np.ndarray  # bias of each filter
    out: np.ndarray  # weights of the logistic layer
    bias: float
    language: np.ndarray  # row x language: log shares of the words
    prior: np.ndarray
    cut: np.ndarray  # per language


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """words x 3 codes of 32 bits (0: no such head) and where each text's words begin.

    A code is the upper half of the hash: its first BITS are the bucket, the rest the tag."""
    tokens = Tokens([t.decode("utf-8", "replace").lower().encode() for t in texts], HEADS)
    words = tokens.is_word
    before = np.concatenate(([0], np.cumsum(words)))
    codes = [(h[words] >> np.uint64(32)).astype(np.uint32) for h in (tokens.hash, *tokens.head)]
    return np.stack(codes, axis=1), before[tokens.first]


def bucket(code: np.ndarray) -> np.ndarray:
    return (code >> np.uint32(32 - BITS)).astype(np.int32)


def tag_of(code: np.ndarray) -> np.ndarray:
    return (code & np.uint32((1 << (32 - BITS)) - 1)).astype(np.uint16)


def rows_of(code: np.ndarray, row_of: np.ndarray, tag: np.ndarray) -> np.ndarray:
    b = bucket(code)
    return np.where((tag[b] == tag_of(code)) & (code != 0), row_of[b], np.int32(0))


def owners(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets' owners from the features of each training text."""
    seen = np.concatenate([np.unique(d) for d in docs]) if docs else np.zeros(0, np.uint32)
    value, texts = np.unique(seen[seen != 0], return_counts=True)
    value, texts = value[texts >= MIN_TEXTS], texts[texts >= MIN_TEXTS]
    order = np.lexsort((value, -texts, bucket(value)))
    value = value[order]
    b = bucket(value)
    first = np.ones(len(b), bool)
    first[1:] = b[1:] != b[:-1]
    value, b = value[first], b[first]
    row_of, tag = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.uint16)
    row_of[b], tag[b] = np.arange(1, len(b) + 1), tag_of(value)
    return row_of, tag, len(b) + 1


class State:
    """What training changes, in one matrix: a row for each embedding and its sum of squares,
    then rows for filters, shifts, logistic layer and their sums of squares."""

    def __init__(self, matrix: np.ndarray, n_rows: int):
        self.emb, self.emb_sq = matrix[:n_rows, :SIZE].copy(), matrix[:n_rows, SIZE:].copy()
        self.rest = matrix[n_rows:].copy()
        rest, at = self.rest.reshape(-1), 0

        def taken(*shape: int) -> np.ndarray:
            nonlocal at
            at += int(np.prod(shape))
            return rest[at - int(np.prod(shape)) : at].reshape(shape)

        self.filt = {w: taken(w * SIZE, FILTERS) for w in WIDTHS}
        self.shift = {w: taken(FILTERS) for w in WIDTHS}
        self.out, self.bias = taken(len(WIDTHS) * FILTERS), taken(1)
        self.sq = {k: taken(1) for k in [*[("f", w) for w in WIDTHS], *[("s", w) for w in WIDTHS], "out", "bias"]}

    @classmethod
    def new(cls, n_rows: int, rng: np.random.Generator) -> State:
        numbers = sum(WIDTHS) * SIZE * FILTERS + 2 * len(WIDTHS) * FILTERS + 1 + 2 * len(WIDTHS) + 2
        state = cls(np.zeros((n_rows + -(-numbers // (SIZE + 1)), SIZE + 1)), n_rows)
        state.emb[:] = rng.normal(0, 0.1, (n_rows, SIZE))
        state.emb[0] = 0
        for w in WIDTHS:
            state.filt[w][:] = rng.normal(0, 0.3, (w * SIZE, FILTERS))
        state.out[:] = np.abs(rng.normal(0, 0.5, len(WIDTHS) * FILTERS))
        state.emb_sq[:] = 1e-2
        for x in state.sq.values():
            x[:] = 1e-2
        return state

    def matrix(self) -> np.ndarray:
        matrix = np.empty((len(self.emb) + len(self.rest), SIZE + 1))
        matrix[: len(self.emb), :SIZE], matrix[: len(self.emb), SIZE:], matrix[len(self.emb) :] = self.emb, self.emb_sq, self.rest
        return matrix


def whole_windows(state: State, vec: np.ndarray, real: int):
    """Of each filter the highest response, its place and its window, by widths."""
    pooled, where, windows = [], [], []
    for w in WIDTHS:
        n = len(vec) - w + 1
        window = np.concatenate([vec[j : j + n] for j in range(w)], axis=1)
        response = window @ state.filt[w] + state.shift[w]
        at = response[:real].argmax(axis=0)
        pooled.append(response[at, np.arange(FILTERS)])
        where.append(at)
        windows.append(window[at])
    return pooled, where, windows


def split_windows(state: State, vec: np.ndarray, real: int):
    """As ``whole_windows`` but for the last digits, in less time: each place of a window by itself, filters x words."""
    pooled, where, windows, row = [], [], [], 0
    parts = np.concatenate([state.filt[w].reshape(w, SIZE, FILTERS).transpose(0, 2, 1).reshape(-1, SIZE) for w in WIDTHS]) @ vec.T
    for w in WIDTHS:
        response = parts[row : row + FILTERS, :real]
        for j in range(1, w):
            response += parts[row + j * FILTERS : row + (j + 1) * FILTERS, j : real + j]
        row += w * FILTERS
        at = response.argmax(axis=1)
        pooled.append(response[np.arange(FILTERS), at] + state.shift[w])
        where.append(at)
        windows.append(vec[at[:, None] + np.arange(w)].reshape(FILTERS, -1))
    return pooled, where, windows


def train_epoch(state: State, docs: list[np.ndarray], labels: np.ndarray, share: float, rng: np.random.Generator, fast: bool = False) -> None:
    """Embeddings, filters and logistic layer, by Adagrad, one text at a time.

    ``docs`` holds words x 3 rows of the embedding table, ``share`` is that of toxic texts.
    ``fast`` moves a word's three rows at once; a row that two words have in other columns then
    adds to its sum of squares once.
    """
    respond = split_windows if fast else whole_windows
    columns = [slice(0, 3)] if fast else [slice(c, c + 1) for c in range(3)]
    emb, emb_sq, filt, shift, out, bias, sq = state.emb, state.emb_sq, state.filt, state.shift, state.out, state.bias, state.sq
    rate = 0.1
    weight = (0.5 / max(1e-6, 1 - share), 0.5 / max(1e-6, share))
    widest = max(WIDTHS)
    for k in rng.permutation(len(docs)):
        words = docs[k]
        if labels[k] and rng.random() < 0.5:
            # Half the words of every other toxic text are hidden: maxima of the words
            # found first would else keep the others from being learned.
            words = words * (rng.random((len(words), 1)) < 0.5)
        real = max(1, len(words))
        words = np.concatenate([words, np.zeros((widest, 3), np.int32)])
        vec = emb.take(words[:, 0], axis=0)
        vec += emb.take(words[:, 1], axis=0)
        vec += emb.take(words[:, 2], axis=0)
        pooled, where, windows = respond(state, vec, real)
        best = np.concatenate(pooled)
        hidden = np.maximum(np.maximum(best, np.concatenate([shift[w] for w in WIDTHS])), 0)
        p = 1 / (1 + np.exp(-np.clip(out @ hidden + bias[0], -30, 30)))
        g = (p - labels[k]) * weight[int(labels[k])]
        if abs(g) < 1e-3:
            continue
        # A toxic text lifts its best words even where they are below what an empty
        # window gives; else words that start low would never be learned.
        back = g * out * ((hidden > 0) & (best >= hidden) | (g < 0))
        g_out = g * hidden + 1e-5 * out
        sq["out"] += g_out @ g_out
        out[:] = np.maximum(out - rate / np.sqrt(sq["out"]) * g_out, 0)
        sq["bias"] += g * g
        bias -= rate / np.sqrt(sq["bias"]) * g
        for i, w in enumerate(WIDTHS):
            d = back[i * FILTERS : (i + 1) * FILTERS]
            if not d.any():
                continue
            g_window = filt[w].T * d[:, None]  # filters x (w * SIZE)
            g_filt = windows[i].T * d
            sq["f", w] += (g_filt * g_filt).sum()
            sq["s", w] += d @ d
            filt[w] -= rate / np.sqrt(sq["f", w]) * g_filt
            shift[w] -= rate / np.sqrt(sq["s", w]) * d
            for j in range(w):
                part = g_window[:, j * SIZE : (j + 1) * SIZE]
                for c in columns:
                    rows = words[where[i] + j, c]  # filters x 3 or 1
                    emb_sq[rows, 0] += (part * part).sum(axis=1)[:, None]
                    np.add.at(emb, rows, (-rate / np.sqrt(emb_sq[rows])) * part[:, None])
            emb[0] = 0


def logits(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Raw score and guessed language of each text."""
    h, first = features(texts)
    n_texts, widest = len(texts), max(WIDTHS)
    rows = rows_of(h, model.row_of, model.tag)
    guess = np.concatenate((np.zeros((1, model.language.shape[1])), np.cumsum(model.language[rows[:, 0]], axis=0, dtype=np.float64)))
    language = (guess[first[1:]] - guess[first[:-1]] + model.prior).argmax(axis=1)
    # Each text gets ``widest`` empty words behind it: windows never meet the next text.
    length = first[1:] - first[:-1]
    begin = first[:-1] + widest * np.arange(n_texts)
    place = np.arange(len(rows)) + widest * np.repeat(np.arange(n_texts), length)
    total = int(length.sum()) + widest * n_texts
    mapped = model.table[rows[:, 0]]
    mapped += model.table[rows[:, 1]]
    mapped += model.table[rows[:, 2]]
    laid = np.zeros((total + widest, mapped.shape[1]), np.float32)
    laid[place] = mapped
    spans = np.stack([begin, begin + length + 1], axis=1).ravel()
    raw, column = np.full(n_texts, model.bias), 0
    for i, w in enumerate(WIDTHS):
        response = laid[:total, column : column + FILTERS].copy()
        for j in range(1, w):
            response += laid[j : total + j, column + j * FILTERS : column + (j + 1) * FILTERS]
        column += w * FILTERS
        pooled = np.maximum.reduceat(response, spans, axis=0)[::2] if n_texts else response[:0]
        part = slice(i * FILTERS, (i + 1) * FILTERS)
        raw += np.maximum(pooled + model.shift[part], 0) @ model.out[part]
    return raw, language


def best_cut(raw: np.ndarray, label: np.ndarray) -> float:
    """Middle of the widest gap among the cuts with the fewest errors."""
    order = np.argsort(raw, kind="stable")
    value, y = raw[order], label[order]
    missed = np.concatenate(([0], np.cumsum(y))) + np.concatenate((np.cumsum((1 - y)[::-1])[::-1], [0]))
    edges = np.concatenate(([value[0] - 1], value, [value[-1] + 1]))
    gap = edges[1:] - edges[:-1]
    best = max(np.flatnonzero(missed == missed.min()), key=lambda i: (gap[i], -i))
    return float((edges[best] + edges[best + 1]) / 2)


def count_words(seen: np.ndarray, rows: np.ndarray, lang: int) -> None:
    """Add a text's words to the counts (row x language), each 20 times at most."""
    row, times = np.unique(rows[:, 0], return_counts=True)
    seen[row, lang] += np.minimum(times, 20)


def made(row_of: np.ndarray, tag: np.ndarray, state: State, seen: np.ndarray, texts: np.ndarray) -> Model:
    """Model without its cuts, ``texts`` are counted by language."""
    columns = [state.filt[w][j * SIZE : (j + 1) * SIZE] for w in WIDTHS for j in range(w)]
    table = (state.emb @ np.concatenate(columns, axis=1)).astype(np.float32)
    share = seen + 0.5
    language = np.log(share / share.sum(axis=0))
    language[0] = 0
    prior = np.log(texts / texts.sum() + 1e-9)
    shift = np.concatenate([state.shift[w] for w in WIDTHS])
    return Model(row_of, tag, table, shift, state.out.copy(), float(state.bias[0]), language.astype(np.float32), prior, np.zeros(len(texts)))


def fit_rows(rows: list[tuple[int, int, str, bytes]]) -> Model | None:
    """From (order, label, lang, hashed words) rows, which are taken out of the list:
    all words lie in one array, so that the driver gives their memory back."""
    rows.sort(key=lambda r: (r[0], r[1], r[3]))
    if len({r[1] for r in rows}) < 2:
        return None
    flat = np.frombuffer(b"".join(r[3] for r in rows), np.uint32).reshape(-1, 3)
    ends = np.cumsum([len(r[3]) // 12 for r in rows])[:-1]
    docs = np.split(flat, ends)
    label = np.array([r[1] for r in rows])
    names = sorted({r[2] or "" for r in rows})
    lang = np.array([names.index(r[2] or "") for r in rows])
    rows.clear()
    aside = np.arange(len(label)) % 5 == 4
    if len(set(label[~aside])) < 2:
        aside[:] = False
    row_of, tag, n_rows = owners([d for d, x in zip(docs, aside) if not x])
    mapped = np.split(rows_of(flat, row_of, tag), ends)
    del docs, flat
    rng = np.random.default_rng(SEED)
    state = State.new(n_rows, rng)
    for _ in range(EPOCHS):
        train_epoch(state, [d for d, x in zip(mapped, aside) if not x], label[~aside], label[~aside].mean(), rng)
    seen = np.zeros((n_rows, len(names)), np.int64)
    for d, k in zip(mapped, lang):
        count_words(seen, d, k)
    model = made(row_of, tag, state, seen, np.bincount(lang, minlength=len(names)))
    raw, guess = [], []
    for d in mapped:
        r, g = logits_of_rows(model, d)
        raw.append(r)
        guess.append(g)
    raw, guess = np.array(raw), np.array(guess)
    held = aside if aside.any() else ~aside
    model.cut[:] = best_cut(raw[held], label[held])
    for k in range(len(names)):
        # A language needs texts of both classes among those left out; else the cut of all holds.
        own = held & (guess == k)
        if min((label[own] == 0).sum(), (label[own] == 1).sum()) >= 10:
            model.cut[k] = best_cut(raw[own], label[own])
    return model


def logits_of_rows(model: Model, rows: np.ndarray) -> tuple[float, int]:
    """One labelled text, known by its words' rows only."""
    guess = model.language[rows[:, 0]].sum(axis=0, dtype=np.float64) + model.prior
    laid = np.zeros((len(rows) + max(WIDTHS), model.table.shape[1]), np.float32)
    laid[: len(rows)] = model.table[rows].sum(axis=1)
    raw, column, n = model.bias, 0, len(laid)
    for i, w in enumerate(WIDTHS):
        response = sum(laid[j : n - w + 1 + j, column + j * FILTERS : column + (j + 1) * FILTERS] for j in range(w))
        column += w * FILTERS
        part = slice(i * FILTERS, (i + 1) * FILTERS)
        raw += float(np.maximum(response.max(axis=0) + model.shift[part], 0) @ model.out[part])
    return raw, int(guess.argmax())


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, piece_rows: int = PIECE_ROWS) -> Model | None:
    """Model from labels.toxic; ``train_rows`` says which labels may be used, of which all are."""
    sample = labelled_rows(docs, labels, "toxic", train_rows, "lang")
    n = sample.count()
    slim = sample.select("order", "label", F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text"))
    if n > piece_rows:
        return fit_pieces(slim, -(-n // piece_rows), piece_rows)
    got = slim.mapInArrow(hashed, "order long, label int, lang string, words binary").collect()
    rows = [(r.order, r.label, r.lang, r.words) for r in got]
    del got
    return fit_rows(rows)


def hashed(parts):
    for batch in parts:
        for rows, texts in batches(batch):
            h, first = features(texts)
            words = [h[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            here = batch.slice(rows.start, len(texts))
            yield pa.RecordBatch.from_arrays([here.column("order"), here.column("label"), here.column("lang"), pa.array(words, pa.binary())], ["order", "label", "lang", "words"])


def in_runs(piece_rows: int):
    """Hashes texts that come sorted by piece, and cuts a piece that is too large into runs."""

    def run(parts):
        piece, place, n, size, number = None, 0, 0, 0, 0
        for batch in parts:
            for rows, texts in batches(batch):
                h, first = features(texts)
                here = batch.slice(rows.start, len(texts))
                words, runs, aside = [], [], []
                for p, a, b in zip(here.column("piece").to_pylist(), first[:-1], first[1:]):
                    if p != piece:
                        piece, place, n, size, number = p, 0, 0, 0, 0
                    elif n >= 2 * piece_rows or size + 12 * (b - a) > PIECE_BYTES:
                        n, size, number = 0, 0, number + 1
                    words.append(h[a:b].tobytes())
                    runs.append(number)
                    aside.append(place % 5 == 4)
                    place, n, size = place + 1, n + 1, size + 12 * (b - a)
                columns = [here.column("piece"), pa.array(runs, pa.int32()), pa.array(aside), here.column("order"), here.column("label"), here.column("lang"), pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["piece", "run", "aside", "order", "label", "lang", "words"])

    return run


def codes_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(w.as_buffer(), np.uint32).reshape(-1, 3) for w in batch.column("words")]


def owners_of(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """As ``owners``, counted by Spark; at most one row for each bucket comes back.

    Rows are numbered from the feature of most texts on, so that what is read often lies together."""

    def counted(parts):
        for batch in parts:
            docs = codes_of(batch)
            for at in range(0, len(docs), 500):
                code, texts = np.unique(np.concatenate([np.unique(d) for d in docs[at : at + 500]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(texts)], ["code", "texts"])

    codes = rows.select("words").mapInArrow(counted, "code long, texts long").where("code <> 0")
    often = codes.groupBy("code").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= MIN_TEXTS)
    first = often.groupBy(F.shiftright("code", 32 - BITS).alias("bucket")).agg(F.max(F.struct("texts", -F.col("code"))).alias("most"))
    most = first.select("most.texts", F.col("most.col2").alias("code")).toArrow()
    texts, value = most["texts"].to_numpy(), -most["code"].to_numpy()
    value = value[np.lexsort((value, -texts))].astype(np.uint32)
    row_of, tag = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.uint16)
    b = bucket(value)
    row_of[b], tag[b] = np.arange(1, len(b) + 1), tag_of(value)
    return row_of, tag, len(b) + 1


def words_seen(rows: DataFrame, names: list[str], row_of: np.ndarray, tag: np.ndarray, n_rows: int) -> np.ndarray:
    """Counts of words by row and language."""
    held = rows.sparkSession.sparkContext.broadcast((names, row_of, tag))

    def counted(parts):
        names, row_of, tag = held.value
        seen = np.zeros((n_rows, len(names)), np.int64)
        for batch in parts:
            for d, lang in zip(codes_of(batch), batch.column("lang").to_pylist()):
                count_words(seen, rows_of(d, row_of, tag), names.index(lang or ""))
        row, lang = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(lang), pa.array(seen[row, lang])], ["row", "lang", "n"])

    sums = rows.select("lang", "words").mapInArrow(counted, "row long, lang long, n long").groupBy("row", "lang").agg(F.sum("n").alias("n")).toArrow()
    held.destroy()
    seen = np.zeros((n_rows, len(names)), np.int64)
    seen[sums["row"].to_numpy(), sums["lang"].to_numpy()] = sums["n"].to_numpy()
    return seen


def epoch_of_pieces(rows: DataFrame, state: State, n_rows: int, row_of: np.ndarray, tag: np.ndarray, share: float, epoch: int) -> State:
    """Every run trains from the given state; a row moves by the mean of the runs that moved it."""
    names = [f"x{i}" for i in range(SIZE + 1)]
    before = state.matrix()
    held = rows.sparkSession.sparkContext.broadcast((before, row_of, tag))

    def trained(parts):
        matrix, row_of, tag = held.value
        moved, times = np.zeros(matrix.shape, np.int64), np.zeros(len(matrix), np.int64)
        now, docs, labels = None, [], []

        def done():
            own = State(matrix, n_rows)
            train_epoch(own, docs, np.array(labels), share, np.random.default_rng((SEED, epoch, *now)), True)
            by = own.matrix()
            by -= matrix
            here = by.any(axis=1)
            moved[here] += np.rint(by[here] * UNIT).astype(np.int64)
            times[here] += 1
            docs.clear()
            labels.clear()

        for batch in parts:
            for piece, run, label, d in zip(batch.column("piece").to_pylist(), batch.column("run").to_pylist(), batch.column("label").to_pylist(), codes_of(batch)):
                if now != (piece, run):
                    if docs:
                        done()
                    now = (piece, run)
                docs.append(rows_of(d, row_of, tag))
                labels.append(label)
        if docs:
            done()
        every = np.flatnonzero(times)
        for at in range(0, len(every), 10_000):
            here = every[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(times[here]), *[pa.array(moved[here, i]) for i in range(SIZE + 1)]], ["row", "times", *names])

    made = rows.select("piece", "run", "label", "words").mapInArrow(trained, f"row long, times long, {', '.join(f'{n} long' for n in names)}")
    sums = made.groupBy("row").agg(*[F.sum(n).alias(n) for n in ("times", *names)]).toArrow()
    held.destroy()
    at, times = sums["row"].to_numpy(), sums["times"].to_numpy()
    for i, n in enumerate(names):
        before[at, i] += sums[n].to_numpy() / (UNIT * times)
    return State(before, n_rows)


def best_cuts(scored: DataFrame) -> dict[int, tuple[float, int, int]]:
    """As ``best_cut`` from (raw, label, guess, order) rows: cut and texts of either class, by guess and, as -1, of all."""
    rows = scored.select("*", F.explode(F.array(F.lit(-1), "guess")).alias("of"))
    inward = Window.partitionBy("of").orderBy("raw", "order", "label")
    rows = rows.select(
        "of",
        "raw",
        "label",
        F.row_number().over(inward).alias("i"),
        F.sum(2 * F.col("label") - 1).over(inward.rowsBetween(Window.unboundedPreceding, 0)).alias("missed"),
        F.coalesce(F.lead("raw").over(inward), F.col("raw") + 1).alias("next"),
    )
    best = F.min(F.struct("missed", (F.col("raw") - F.col("next")).alias("gap"), "i", ((F.col("raw") + F.col("next")) / 2).alias("cut")))
    sums = rows.groupBy("of").agg(best.alias("best"), F.min("raw").alias("least"), F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n"))
    # A cut below all texts is none of the rows' own.
    return {r.of: (min(tuple(r.best), (0, -1.0, 0, r.least - 0.5))[3], r.n - r.ones, r.ones) for r in sums.collect()}


def fit_pieces(slim: DataFrame, pieces: int, piece_rows: int) -> Model | None:
    """As ``fit_rows`` by tasks, from (order, label, lang, text) rows. A row's piece depends on its doc_id and text only."""
    dealt = slim.withColumn("piece", F.pmod(F.xxhash64("order", "text"), F.lit(pieces)).cast("int"))
    dealt = dealt.repartitionById(pieces, F.col("piece")).sortWithinPartitions("piece", "order", "label", "lang", "text")
    rows = stored(dealt.mapInArrow(in_runs(piece_rows), "piece int, run int, aside boolean, order long, label int, lang string, words binary"), "toxicity-rows", "zstd")
    counts = rows.groupBy("aside", "label", F.coalesce("lang", F.lit("")).alias("lang")).count().collect()
    if len({r.label for r in counts}) < 2:
        return None
    names = sorted({r.lang for r in counts})
    texts = np.zeros(len(names), np.int64)
    for r in counts:
        texts[names.index(r.lang)] += r["count"]
    whole = len({r.label for r in counts if not r.aside}) < 2 or not any(r.aside for r in counts)
    train, held = (rows, rows) if whole else (rows.where("not aside"), rows.where("aside"))
    used = [r for r in counts if whole or not r.aside]
    share = sum(r["count"] * r.label for r in used) / sum(r["count"] for r in used)
    row_of, tag, n_rows = owners_of(train)
    state = State.new(n_rows, np.random.default_rng(SEED))
    for epoch in range(EPOCHS):
        state = epoch_of_pieces(train, state, n_rows, row_of, tag, share, epoch)
    model = made(row_of, tag, state, words_seen(rows, names, row_of, tag, n_rows), texts)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def scored(parts):
        model = sent.value
        for batch in parts:
            raw = [logits_of_rows(model, rows_of(d, model.row_of, model.tag)) for d in codes_of(batch)]
            columns = [pa.array([float(r) for r, _ in raw], pa.float64()), pa.array([g for _, g in raw], pa.int32()), batch.column("label"), batch.column("order")]
            yield pa.RecordBatch.from_arrays(columns, ["raw", "guess", "label", "order"])

    cuts = best_cuts(held.select("label", "order", "words").mapInArrow(scored, "raw double, guess int, label int, order long"))
    sent.destroy()
    model.cut[:] = cuts[-1][0]
    for k, (cut, zeros, ones) in cuts.items():
        if k >= 0 and min(zeros, ones) >= 10:
            model.cut[k] = cut
    return model


def score_texts(model: Model | None, texts: list[bytes]) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    raw, language = logits(model, texts)
    return 1 / (1 + np.exp(-np.clip(raw - model.cut[language], -35, 35)))


def score(docs: DataFrame, model: Model | None, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """doc_id and score of every document; with ``keep``, those columns
    (whole rows, for filters) and the score as ``name``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    columns = keep or ["doc_id"]
    # A text that is passed on is read where it lies; else a column of its own brings it.
    text = columns.index("text") if "text" in columns and dict(docs.dtypes)["text"] == "string" else len(columns)

    def scored(parts):
        for batch in parts:
            yield from score_pieces(held.value, batch, columns, text)

    given = [F.col(f"`{c}`") for c in columns]
    slim = docs.select(*given, *([F.col("text").cast("binary").alias("_bytes")] if text == len(columns) else []))
    schema = docs.select(*given).schema.add("_score", "double")
    return slim.mapInArrow(scored, schema).withColumnRenamed("_score", name)


def score_pieces(model: Model | None, batch: pa.RecordBatch, columns: list[str], text: int):
    """``columns``, the first of the batch, and the score; ``text`` is the place of the texts. Each word of a
    piece has a row of floats for all filters, so that pieces are short."""
    texts = pa.RecordBatch.from_arrays([batch.column(text).cast(pa.binary())], ["text"])
    for rows, some in batches(texts, most=PIECE):
        here = batch.slice(rows.start, len(some))
        yield pa.RecordBatch.from_arrays([here.column(i) for i in range(len(columns))] + [pa.array(score_texts(model, some))], [*columns, "_score"])
