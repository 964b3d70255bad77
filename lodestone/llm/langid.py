"""Language identification by a linear-chain conditional random field over words.

Every word gets features - its character n-grams with word boundaries, its affixes and itself as a lexicon entry, all
hashed - and learned weights per language; learned transitions join neighbouring words. Forward-backward gives each
word's language probabilities, so that code-switched text is labelled word by word; a document takes the language with
the greatest sum, and its mean probability is the score.

The model is fitted on the driver on a bounded sample of labelled documents (about TRAIN_DOCS of them, by a hash of the
id and text, equally many of each language, with at most TRAIN_CHARS characters each; never over 4 * TRAIN_DOCS) as whole sequences and as spliced ones that
switch languages, and is sent to the workers; its size is fixed by BUCKETS and the number of languages. Prediction uses
whole texts: forward-backward runs over chunks of all documents at once, and the messages between the chunks of a long
text are passed on exactly by their transfer matrices.

Defined results: null text and text without a letter is `und` with score 0. Without any labelled row everything is
`und`. Words without letters are left out. Repeated rows get equal results, equally likely languages go to the first by
name. Texts of any length are labelled whole; an empty table gives an empty one. Extra columns are carried through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.shared import by_length, giving_back, hash_fraction, size_checked
from lodestone.plans.workspace import reach_workers

UNKNOWN = "und"
TRAIN_DOCS, TRAIN_CHARS = 800, 20_000
BUCKETS = 1 << 18
STEPS, RATE, DECAY = 30, 0.5, 1e-4
SPLICES, SPAN = 1500, 64
CHUNK, TOKENS, WORDS = 256, 200_000, 10_000
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _P2
    x = (x ^ (x >> np.uint64(27))) * _P3
    return x ^ (x >> np.uint64(31))


def plain(word: str) -> str:
    """A word's letters and what stands between them, lower-cased; nothing if it has no letter."""
    return _EDGE.sub("", word).lower() if any(map(str.isalpha, word)) else ""


def features(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' features, word after word, and where each word's begin."""
    if not words:
        return np.empty(0, "int64"), np.empty(0, "int64")
    codes = np.frombuffer(("\2" + "\3\2".join(words) + "\3").encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64")
    first = codes == 2
    word = np.cumsum(first) - 1
    begins = np.flatnonzero(first)
    with np.errstate(over="ignore"):
        place = np.arange(len(codes)) - begins[word]
        whole = np.add.reduceat(_mix((codes + _P1) * (place.astype("uint64") * np.uint64(2) + np.uint64(1))), begins)
        owners, found = [np.arange(len(words))], [_mix(whole * _P1)]
        gram = codes
        for n in range(2, 6):
            gram = gram[:-1] * _P1 + codes[n - 1 :] * _P3 + np.uint64(n)
            ok = word[: len(gram)] == word[n - 1 :]
            if n > 3:  # affixes
                ok &= first[: len(gram)] | (codes[n - 1 :] == 3)
            owners.append(word[: len(gram)][ok])
            found.append(_mix(gram[ok]))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    at = (np.concatenate(found)[order] % np.uint64(buckets)).astype("int64")
    return at, np.searchsorted(owner[order], np.arange(len(words)))


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # buckets x languages
    moves: np.ndarray  # log weights of a transition
    first: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Unnormalised probabilities of each word's languages, the greatest 1."""
        out = np.empty((len(words), len(self.langs)))
        for a in range(0, len(words), WORDS):
            at, begins = features(words[a : a + WORDS], len(self.weights))
            scores = np.add.reduceat(self.weights[at], begins, axis=0).astype("float64")
            out[a : a + WORDS] = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -50))
        return out

    def known(self, words: list[str]) -> np.ndarray:
        """Share of each word's features that training met; a bucket that it did not meet keeps the weight 0."""
        met, out = self.weights.any(axis=1), np.empty(len(words))
        for a in range(0, len(words), WORDS):
            at, begins = features(words[a : a + WORDS], len(self.weights))
            out[a : a + WORDS] = np.add.reduceat(met[at].astype("float64"), begins) / np.diff(np.append(begins, len(at)))
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def marginals(e: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray, final: np.ndarray, pairs: bool = False):
    """Forward-backward over sequences of descending length: e is sequences x places x languages, start and final are
    the messages that reach the first and the last place. Returns the marginals and, with pairs, the expected transitions."""
    n, places, langs = e.shape
    active = np.searchsorted(-lengths, -np.arange(places), side="left")  # sequences longer than t
    forward = np.zeros_like(e)
    forward[:, 0] = _unit(start * e[:, 0])
    for t in range(1, places):
        m = active[t]
        forward[:m, t] = _unit((forward[:m, t - 1] @ moves) * e[:m, t])
    out, counts = np.zeros_like(e), np.zeros((langs, langs))
    back = final.copy()
    for t in range(places - 1, -1, -1):
        m = active[t]
        out[:m, t] = _unit(forward[:m, t] * back[:m])
        if t:
            ahead = e[:m, t] * back[:m]
            if pairs:
                joint = forward[:m, t - 1, :, None] * moves * ahead[:, None, :]
                counts += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back[:m] = _unit(ahead @ moves.T)
    return (out, counts) if pairs else out


def document_sums(model: Model, rows: list[np.ndarray], chunk: int = CHUNK, tokens: int = TOKENS) -> np.ndarray:
    """Per document the sum of its words' marginals; rows are the documents' emissions."""
    langs = len(model.langs)
    moves, first = np.exp(model.moves), np.exp(model.first)
    total = np.zeros((len(rows), langs))
    group: list[int] = []
    size = 0
    for i in sorted(range(len(rows)), key=lambda i: len(rows[i])):
        if len(rows[i]):
            group.append(i)
            size += len(rows[i])
        if group and (size >= tokens or len(rows[i]) > tokens):
            _sum_group(model, rows, group, chunk, moves, first, total)
            group, size = [], 0
    if group:
        _sum_group(model, rows, group, chunk, moves, first, total)
    return total


def _sum_group(model, rows, group, chunk, moves, first, total) -> None:
    langs = len(model.langs)
    pieces = [(i, a) for i in group for a in range(0, len(rows[i]), chunk)]
    lengths = np.array([min(chunk, len(rows[i]) - a) for i, a in pieces])
    start, final = np.tile(first, (len(pieces), 1)), np.ones((len(pieces), langs))
    longs = [k for k, (i, _) in enumerate(pieces) if len(rows[i]) > chunk]
    if longs:
        transfer = _transfers(rows, pieces, longs, chunk, moves)
        begins = {pieces[k][0]: k for k in reversed(longs)}  # a document's chunks stand together
        for i, k0 in begins.items():
            own = range(k0, k0 + -(-len(rows[i]) // chunk))
            message = first
            for k in own:
                if k != k0:
                    start[k] = message @ moves
                message = _unit(message @ transfer[k])
            back = np.ones(langs)
            for k in reversed(own):
                final[k] = back
                back = _unit(transfer[k] @ back)
    order = np.argsort(-lengths, kind="stable")
    e = np.ones((len(pieces), lengths.max(), langs))
    for r, k in enumerate(order):
        i, a = pieces[k]
        e[r, : lengths[k]] = rows[i][a : a + lengths[k]]
    out = marginals(e, lengths[order], moves, start[order], final[order]).sum(axis=1)
    np.add.at(total, [pieces[k][0] for k in order], out)


def _transfers(rows, pieces, longs, chunk, moves) -> dict[int, np.ndarray]:
    """Per chunk the matrix that takes the message before it to the one after it; a document's first chunk is entered
    without a transition."""
    langs = len(moves)
    lengths = np.array([min(chunk, len(rows[pieces[k][0]]) - pieces[k][1]) for k in longs])
    order = np.argsort(-lengths, kind="stable")
    e = np.ones((len(longs), lengths.max(), langs))
    m = np.empty((len(longs), langs, langs))
    for r, o in enumerate(order):
        i, a = pieces[longs[o]]
        e[r, : lengths[o]] = rows[i][a : a + lengths[o]]
        m[r] = np.eye(langs) if a == 0 else moves
    m *= e[:, 0, None, :]
    active = np.searchsorted(-lengths[order], -np.arange(e.shape[1]), side="left")
    for t in range(1, e.shape[1]):
        n = active[t]
        m[:n] = (m[:n] @ moves) * e[:n, t, None, :]
        m[:n] /= m[:n].max(axis=(1, 2), keepdims=True)
    return {longs[o]: m[r] for r, o in enumerate(order)}


def fit(samples: list[tuple[str, str]], buckets: int = BUCKETS, steps: int = STEPS, seed: int = 7) -> Model:
    """A model from (text, language) pairs, by full-batch Adagrad on the conditional likelihood."""
    langs = sorted({lang for _, lang in samples})
    number = {lang: i for i, lang in enumerate(langs)}
    vocabulary: dict[str, int] = {}
    texts = []
    for text, lang in samples:
        words = [vocabulary.setdefault(w, len(vocabulary)) for w in map(plain, text.split()) if w]
        if words:
            texts.append((np.array(words), number[lang]))
    model = Model(langs, np.zeros((buckets, len(langs)), "float32"), np.zeros((len(langs), len(langs))), np.zeros(len(langs)))
    if not texts:
        return model
    sequences = [(w[a : a + SPAN], np.full(len(w[a : a + SPAN]), y)) for w, y in texts for a in range(0, len(w), SPAN)]
    rng = np.random.default_rng(seed)
    for _ in range(min(SPLICES, 4 * len(texts)) if len(langs) > 1 else 0):
        words, ys = [], []
        while sum(map(len, words)) < SPAN:
            w, y = texts[rng.integers(len(texts))]
            a, n = rng.integers(len(w)), rng.integers(4, 25)
            words.append(w[a : a + n])
            ys.append(np.full(len(words[-1]), y))
        sequences.append((np.concatenate(words)[:SPAN], np.concatenate(ys)[:SPAN]))
    sequences.sort(key=lambda s: -len(s[0]))
    lengths = np.array([len(w) for w, _ in sequences])
    tokens = np.zeros((len(sequences), lengths[0]), "int64")
    gold = np.zeros((len(sequences), lengths[0]), "int64")
    for r, (w, y) in enumerate(sequences):
        tokens[r, : len(w)], gold[r, : len(y)] = w, y
    real = np.arange(lengths[0]) < lengths[:, None]
    at, begins = features(list(vocabulary), buckets)
    per_word = np.diff(np.append(begins, len(at)))
    size = len(langs)
    flat = tokens[real]
    seen = np.bincount(flat * size + gold[real], minlength=len(vocabulary) * size).reshape(-1, size)
    both = real[:, 1:]
    moved = np.bincount(gold[:, :-1][both] * size + gold[:, 1:][both], minlength=size * size).reshape(size, size)
    begun = np.bincount(gold[:, 0], minlength=size)
    squares = [np.full(x.shape, 1e-6) for x in (model.weights, model.moves, model.first)]
    n = real.sum()
    for _ in range(steps):
        scores = np.add.reduceat(model.weights[at], begins, axis=0).astype("float64")
        e = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -50))[tokens]
        start, final = np.tile(np.exp(model.first), (len(sequences), 1)), np.ones((len(sequences), size))
        out, counts = marginals(e, lengths, np.exp(model.moves), start, final, pairs=True)
        expected = np.stack([np.bincount(flat, out[..., j][real], minlength=len(vocabulary)) for j in range(size)], axis=1)
        by_word = seen - expected
        slope = np.stack([np.bincount(at, np.repeat(by_word[:, j], per_word), minlength=buckets) for j in range(size)], axis=1) / n
        for x, g, s in zip(
            (model.weights, model.moves, model.first),
            (slope - DECAY / 100 * model.weights, (moved - counts) / n - DECAY * model.moves, (begun - out[:, 0].sum(axis=0)) / n - DECAY * model.first),
            squares,
        ):
            s += (g * 1e3) ** 2
            x += (RATE * g * 1e3 / np.sqrt(s)).astype(x.dtype)
    return model


class Labeller:
    """A model with the emissions of the words that it has met, forgotten when too many."""

    def __init__(self, model: Model, most: int = 150_000):
        self.model, self.most = model, most
        self.forget()

    def forget(self):
        self.ids: dict[str, int] = {}
        self.table = np.empty((0, len(self.model.langs)))

    def rows(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.ids) > self.most:
            self.forget()
        ids, news, found = self.ids, [], []
        for text in texts:
            own = []
            for w in (text or "").split():
                i = ids.get(w)
                if i is None:
                    p = plain(w)
                    if not p:
                        i = -1
                    else:
                        i = len(self.table) + len(news)
                        news.append(p)
                    ids[w] = i
                if i >= 0:
                    own.append(i)
            found.append(own)
        if news:
            self.table = np.concatenate([self.table, self.model.emissions(news)])
        return [self.table[x] if x else np.empty((0, len(self.model.langs))) for x in found]

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        return [found for run in by_length(texts) for found in self._label(run)]

    def _label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        langs = self.model.langs
        if not langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        rows = self.rows(texts)
        sums = document_sums(self.model, rows)
        out = []
        for row, s in zip(rows, sums):
            if len(row):
                best = int(s.argmax())
                out.append((langs[best], float(min(1.0, max(0.0, s[best] / len(row))))))
            else:
                out.append((UNKNOWN, 0.0))
        return out

    def known(self, texts: list[str | None]) -> list[float]:
        """Mean share of known features over the words of each text; 0 without a word. Unlike the score, it does not
        compare languages: it is high in any mixture of learned ones and low in others, whichever they resemble most."""
        out = []
        for run in by_length(texts):
            owns = [[p for p in map(plain, (t or "").split()) if p] for t in run]
            place = {w: i for i, w in enumerate(dict.fromkeys(w for own in owns for w in own))}
            share = self.model.known(list(place)) if self.model.langs else np.zeros(len(place))
            out += [float(share[[place[w] for w in own]].mean()) if own else 0.0 for own in owns]
        return out

    def words(self, text: str) -> list[tuple[str, str]]:
        """Each word of a text with its own most probable language; `und` for words without letters."""
        parts = text.split()
        rows = self.rows([text])[0]
        if not len(rows):
            return [(w, UNKNOWN) for w in parts]
        out = marginals(rows[None], np.array([len(rows)]), np.exp(self.model.moves), np.exp(self.model.first)[None], np.ones((1, len(self.model.langs))))[0]
        labels = iter(self.model.langs[i] for i in out.argmax(axis=1))
        return [(w, next(labels) if self.ids[w] >= 0 else UNKNOWN) for w in parts]


def train(docs: DataFrame, allowed: Column, *, key: str = "doc_id", text: str = "text", lang: str = "lang", docs_wanted: int = TRAIN_DOCS) -> Model:
    """A model from the labelled rows of docs for which allowed holds."""
    rows = docs.filter(allowed & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        hash_fraction(F.concat_ws(" ", F.col(key), F.md5(F.col(text).cast("string"))), "langid").alias("_u"), F.col(text).cast("string").alias("_text"), F.col(lang).cast("string").alias("_lang")
    )
    counts = rows.groupBy("_lang").agg(F.count("*").alias("_n"))
    share = F.lit(float(docs_wanted)) / F.count("*").over(Window.partitionBy(F.lit(0)))  # over a row per language
    counts = counts.select("_lang", (F.greatest(share, F.lit(50.0)) / F.col("_n")).alias("_share"))
    picked = rows.filter(F.length("_text") <= TRAIN_CHARS).join(size_checked(counts), "_lang").filter("_u < _share")
    return fit([(r["_text"], r["_lang"]) for r in picked.orderBy("_u", "_text").limit(4 * docs_wanted).select("_text", "_lang").collect()])


def label(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None, evidence: bool = False) -> DataFrame:
    """The columns of docs (or those in keep) with lang_pred, score and, with evidence, known, which replace input
    columns of these names."""
    added = ["lang_pred", "score", *["known"] * evidence]
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    place = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    inner = docs.toDF(*place.values()).select(*[place[c] for c in names], F.col(place[text]).cast("string").alias("_text"))
    schema = T.StructType([*inner.schema.fields[:-1], T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType()), *[T.StructField("_known", T.DoubleType())] * evidence])
    reach_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        labeller = Labeller(shared.value)
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            found = labeller.label(texts)
            more = [pa.array(labeller.known(texts), pa.float64())] if evidence else []
            yield pa.record_batch(
                [*batch.columns[: len(names)], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), *more],
                names=[*batch.schema.names[: len(names)], "_lang", "_score", *["_known"] * evidence],
            )

    return inner.mapInArrow(giving_back(run), schema).toDF(*names, *added)


def identify(docs: DataFrame, allowed: Column, *, key: str = "doc_id", text: str = "text", lang: str = "lang", keep: list[str] | None = None, evidence: bool = False) -> DataFrame:
    """Train on the allowed labelled rows and label all."""
    return label(docs, train(docs, allowed, key=key, text=text, lang=lang), text=text, keep=keep, evidence=evidence)
