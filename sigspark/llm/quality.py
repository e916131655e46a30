"""Quality and toxicity by co-training: a word view and a page view teach each other, then vote."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import stored

TARGETS = ("quality", "toxic")
_ENDS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_CACHE: dict[str, np.ndarray] = {}
#: Words whose features a worker keeps at hand.
CACHE_WORDS = 1 << 18
#: Log odds (of 0.95) from which a view is sure of a row.
SURE = float(np.log(19))
#: Tasks that merge the surest rows of the partitions.
MERGERS = 16
#: Columns of the page view before binning.
PAGE = ("characters", "words", "lines", "words_a_line", "upper", "signs", "digits", "distinct", "longest_run", "characters_a_word")


def _word_features(word: str) -> np.ndarray:
    """32-bit hashes of a word and of its starts."""
    found = _CACHE.get(word)
    if found is None:
        if len(_CACHE) >= CACHE_WORDS:
            _CACHE.clear()
        parts = [word, *("^" + word[:k] for k in (4, 5, 6, 7) if k <= len(word))]
        found = _CACHE[word] = np.array([zlib.crc32(p.encode()) for p in parts], np.uint32)
    return found


def words_in(text: str | None) -> np.ndarray:
    """Sorted features that a text has; its words lower-cased, signs at their ends cut off."""
    words = {w.strip(_ENDS) for w in (text or "").lower().split()}
    words.discard("")
    return np.unique(np.concatenate([_word_features(w) for w in words])) if words else np.empty(0, np.uint32)


def page_of(text: str | None) -> list[float]:
    """Layout of a text, without its words (PAGE)."""
    text = text or ""
    words = text.split()
    n, c = max(1, len(words)), max(1, len(text))
    data = np.frombuffer(text.encode(), np.uint8)
    letters = int(((data >= 65) & (data <= 90)).sum()), int(((data >= 97) & (data <= 122)).sum())
    signs = int((((data >= 33) & (data < 48)) | ((data >= 58) & (data < 65)) | ((data >= 91) & (data < 97)) | ((data > 122) & (data < 127))).sum())
    usual = text.count(".") + text.count(",")
    lines = text.count("\n") + 1
    same = np.flatnonzero(np.append(np.array(words[1:], object) != np.array(words[:-1], object), True)) if words else np.array([0])
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(lines), np.log1p(n / lines), letters[0] / max(1, sum(letters)), (signs - usual) / n,
        float(((data >= 48) & (data < 58)).sum()) / c, len(set(words)) / n, np.log1p(np.diff(same, prepend=-1).max()), np.log1p(c / n),
    ]


def _bucket(kind: str, value) -> int:
    return zlib.crc32(f"{kind}={value}".encode()) % 64


@dataclass
class Linear:
    """Logistic regression with a ridge, fitted by accelerated gradient steps."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 200) -> Linear:
        x = np.concatenate([x, np.ones((len(x), 1))], axis=1, dtype=np.float32)
        weight = (weight / weight.sum()).astype(np.float32)
        y = y.astype(np.float32)
        # A quarter of the trace bounds the curvature; features are sparse, so it is far too careful.
        limit = 0.0625 * float(weight @ np.einsum("ij,ij->i", x, x)) + ridge
        w = v = np.zeros(x.shape[1], np.float32)
        for k in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
            step = v - ((weight * (p - y)) @ x + np.float32(ridge) * v) / np.float32(limit)
            w, v = step, step + np.float32(k / (k + 3)) * (step - w)
        self.weights, self.bias = w[:-1], float(w[-1])
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


@dataclass
class Model:
    """What scoring needs: chosen words, bin edges, and per target two views, their scales and their vote."""

    chosen: np.ndarray
    edges: np.ndarray
    views: dict
    votes: dict

    def word_matrix(self, ids: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(ids), len(self.chosen)), np.float32)
        for k, found in enumerate(ids):
            out[k, found] = 1
        return out

    def page_matrix(self, page: np.ndarray, lang: list, source: list) -> np.ndarray:
        """Bins of every layout figure, and buckets of language and source."""
        n, bins = len(page), self.edges.shape[1] + 1
        out = np.zeros((n, page.shape[1] * bins + 128), np.float32)
        for c in range(page.shape[1]):
            out[np.arange(n), c * bins + np.searchsorted(self.edges[c], page[:, c])] = 1
        for k in range(n):
            out[k, -128 + _bucket("lang", lang[k])] = out[k, -64 + _bucket("source", source[k])] = 1
        return out

    def places(self, ids: list[np.ndarray], page: np.ndarray, lang: list, source: list) -> tuple:
        """Where both matrices have their ones: row and column of the word view, columns of the page view."""
        n, bins = len(page), self.edges.shape[1] + 1
        at = np.repeat(np.arange(n), np.fromiter(map(len, ids), int, n))
        columns = [c * bins + np.searchsorted(self.edges[c], page[:, c]) for c in range(len(PAGE))]
        columns += [len(PAGE) * bins + np.array([_bucket("lang", v) for v in lang], int), len(PAGE) * bins + 64 + np.array([_bucket("source", v) for v in source], int)]
        return at, np.concatenate([*ids, np.empty(0, int)]).astype(int), np.stack(columns, axis=1)

    def logits(self, target: str, places: tuple) -> list[np.ndarray]:
        """Of either view, summed row by row in a fixed order, so that no batch changes a digit."""
        (words, _), (pages, _) = self.views[target]
        at, found, columns = places
        own = np.bincount(at, words.weights.astype(float)[found], len(columns))
        return [own + words.bias, pages.weights.astype(float)[columns].sum(axis=1) + pages.bias]

    def scores(self, target: str, places: tuple) -> np.ndarray:
        calibrated = np.stack([scale.logit(x[:, None]) for (_, scale), x in zip(self.views[target], self.logits(target, places))], axis=1)
        return 1 / (1 + np.exp(-np.clip(self.votes[target].logit(np.clip(calibrated, -8, 8)), -30, 30)))


def _counter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [words_in(t) for t in batch["text"]]
        every = np.concatenate(found) if found else np.empty(0, np.uint32)
        feature, at = np.unique(every, return_inverse=True)
        out = {"feature": feature.astype(np.int64), "n": np.bincount(at, minlength=len(feature))}
        for target in TARGETS:
            out[target] = np.bincount(at, np.repeat(batch[target].to_numpy(float), [len(f) for f in found]), len(feature)).astype(np.int64)
        yield pd.DataFrame(out)


def _chosen_in(chosen: np.ndarray, text: str | None) -> np.ndarray:
    found = words_in(text)
    at = np.searchsorted(chosen, found)
    at = at[(at < len(chosen))]
    found = found[: len(at)]  # both are sorted: only larger ones are off the end
    return at[chosen[at] == found] if len(at) else at


def _digester(chosen: np.ndarray):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids = pa.array([_chosen_in(chosen, t).astype(np.int16).tobytes() for t in texts], pa.binary())
            page = pa.array([page_of(t) for t in texts], pa.list_(pa.float64()))
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), ids, page], [*rest, "ids", "page"])

    return digest


def digested(rows: DataFrame, chosen: np.ndarray) -> DataFrame:
    """``rows`` with ``ids`` (places among the chosen words, 16 bits each) and ``page`` instead of ``text``."""
    rest = rows.drop("text")
    return rows.mapInArrow(_digester(chosen), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + ", ids binary, page array<double>")


def _pages(column) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), len(PAGE))


def edges_of(digest: DataFrame, shares: np.ndarray) -> np.ndarray:
    """Quantiles of every layout figure over all rows, in steps of 1/256."""
    step = F.round(F.col("v") * 256).cast("long").alias("step")
    found = digest.select(F.posexplode("page").alias("c", "v")).groupBy("c", step).count().toPandas()
    edges = np.zeros((len(PAGE), len(shares)))
    for c, own in found.sort_values("step").groupby("c"):
        upto = own["count"].to_numpy().cumsum()
        edges[c] = own["step"].to_numpy()[np.searchsorted(upto, np.floor(shares * (upto[-1] - 1)), "right")] / 256
    return edges


#: A candidate: which target, view and class (``slot``) it is sure of, how sure, and its digest.
CANDIDATE = "slot int, sure double, key binary, ids binary, page array<double>, lang string, source string"
_OFFER = pa.schema([("slot", pa.int32()), ("sure", pa.float64()), ("key", pa.binary()), ("ids", pa.binary()), ("page", pa.list_(pa.float64())), ("lang", pa.string()), ("source", pa.string())])


def _best(found: pd.DataFrame, most: int) -> pd.DataFrame:
    """The ``most`` surest different rows of every slot; ties by ``key``."""
    found = found.sort_values(["slot", "sure", "key"], ascending=[True, False, True], ignore_index=True)
    return found.drop_duplicates(["slot", "key"]).groupby("slot").head(most)


def _candidates(model, given, most: int):
    """The surest rows of a partition per slot; ``given`` has per slot the keys that were handed over before."""
    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, floor = None, {}
        for batch in batches:
            lang, source, raw = (batch.column(c).to_pylist() for c in ("lang", "source", "ids"))
            page, keys, rows = _pages(batch.column("page")), {}, []
            places = model.value.places([np.frombuffer(x, np.int16) for x in raw], page, lang, source)
            for t, target in enumerate(TARGETS):
                for k, logit in enumerate(model.value.logits(target, places)):
                    for value in (0, 1):
                        slot, sure, seen = 4 * t + 2 * k + value, logit if value else -logit, set()
                        able = np.flatnonzero(sure >= floor.get(slot, SURE))
                        last = None
                        for i in able[np.argsort(-sure[able], kind="stable")].tolist():
                            if len(seen) >= most and sure[i] < last:  # rows as sure as the last one go by key
                                break
                            if i not in keys:
                                keys[i] = xxhash.xxh3_128_digest(raw[i] + page[i].tobytes() + repr((lang[i], source[i])).encode())
                            if keys[i] not in seen and keys[i] not in given.value[slot]:
                                seen.add(keys[i])
                                last = sure[i]
                                rows.append((slot, sure[i], keys[i], raw[i], page[i].tolist(), lang[i], source[i]))
            if rows:
                part = pd.DataFrame(rows, columns=_OFFER.names)
                best = _best(part if best is None else pd.concat([best, part]), most)
                floor = {slot: own.min() for slot, own in best.groupby("slot")["sure"] if len(own) >= most}
        if best is not None:
            yield pa.RecordBatch.from_pandas(best, preserve_index=False, schema=_OFFER)

    return offer


def _merger(most: int):
    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for batch in batches:
            best = _best(batch if best is None else pd.concat([best, batch]), most)
        if best is not None:
            yield best

    return merge


def surest(open_rows: DataFrame, model: Model, given: list[set], most: int) -> pd.DataFrame:
    """The ``most`` surest of all ``open_rows`` per slot: of a partition, of a share of the keys, of all."""
    context = open_rows.sparkSession.sparkContext
    part = open_rows.select("ids", "page", "lang", "source").mapInArrow(_candidates(context.broadcast(model), context.broadcast(given), most), CANDIDATE)
    return _best(part.repartition(MERGERS, "key").mapInPandas(_merger(most), CANDIDATE).toPandas(), most)


def choose_words(sample: DataFrame, most: int) -> np.ndarray:
    """The ``most`` features per target that tell most about it, by likelihood ratio on the labelled rows."""
    counts = sample.filter("quality IS NOT NULL").select("text", *TARGETS).mapInPandas(_counter, "feature long, n long, quality long, toxic long")
    counts = counts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", *TARGETS)]).filter("n > 2")
    rows = sample.filter("quality IS NOT NULL").agg(F.count("*").alias("n"), *[F.sum(t).alias(t) for t in TARGETS]).first()
    total, out = max(1, rows["n"]), set()
    for target in TARGETS:
        share = ((rows[target] or 0) + 0.5) / (total + 1)
        n, one = F.col("n"), F.col(target)
        # Twice the log likelihood ratio of the rate among rows with the feature.
        part = lambda k, p: F.when(k > 0, k * F.log(k / (n * F.lit(p)))).otherwise(F.lit(0.0))
        told = 2 * (part(one, share) + part(n - one, 1 - share))
        out |= {r[0] for r in counts.select("feature", told.alias("told")).filter("told > 8").orderBy(F.desc("told"), "feature").limit(most).collect()}
    return np.array(sorted(out), np.uint32)


def train(docs: DataFrame, labels: DataFrame, labelled: int = 6000, most: int = 300, rounds: int = 3, words: int = 512, seed: int = 3, carry: tuple[str, ...] = ()) -> tuple[Model, DataFrame]:
    """Fit both views for both targets; also the digests of all rows, with the ``carry`` columns as ``row``.

    ``labelled`` rows with labels, in the order of a hash of the id, are the sample that words
    are chosen on and learning starts from; a fifth of them is held out. Every row without a
    label is a candidate: in each round each view judges all of them, and the different rows
    it is surest of (``most`` of either class, at most a tenth of all candidates, and at least
    0.95 sure) are added, with half weight, to what the other view learns from. A row is handed
    over once. A view that does worse on the rows held out with what it was handed, beyond chance, gives
    it back and stays as it was. On the rows held out each view's output is calibrated and their vote is weighed.
    """
    order = lambda c: F.xxhash64(F.lit(seed), c)
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic")
    )
    taken = marks.orderBy(order(F.col("doc_id")), "doc_id").limit(labelled)
    sample = stored(docs.join(taken, "doc_id").select("doc_id", "text", "lang", "source", "quality", "toxic"), "sample")
    chosen = choose_words(sample, words)
    table = digested(sample, chosen).toPandas().sort_values("doc_id", kind="stable", ignore_index=True)
    row = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    digest = stored(digested(docs.select(*row, "doc_id", "text", "lang", "source"), chosen), "digest")
    model = Model(chosen, edges_of(digest, np.linspace(0.02, 0.98, 25)), {}, {})
    if not len(table) or not rounds:
        return fit(table, model, seed), digest
    # Rows without an id have no label; kept apart, they do not meet in one task of the join.
    digests = digest.select("doc_id", "ids", "page", "lang", "source")
    open_rows = stored(digests.filter("doc_id IS NOT NULL").join(marks, "doc_id", "left_anti").union(digests.filter("doc_id IS NULL")), "open")
    most = min(most, max(1, open_rows.count() // 10))
    given = [set() for _ in range(8)]

    def offers(now: Model) -> pd.DataFrame:
        found = surest(open_rows, now, given, most)
        for slot, key in zip(found["slot"], found["key"]):
            for value in (0, 1):  # of one class only
                given[slot // 2 * 2 + value].add(key)
        return found

    return fit(table, model, seed, rounds, offers), digest


def fit(table: pd.DataFrame, model: Model, seed: int, rounds: int = 0, offers=None) -> Model:
    """Both views on the labelled rows and, round by round, on what ``offers(model)`` finds for them."""
    def sides(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        page = np.array(rows["page"].tolist(), float).reshape(len(rows), len(PAGE))
        return model.word_matrix([np.frombuffer(x, np.int16) for x in rows["ids"]]), model.page_matrix(page, rows["lang"].tolist(), rows["source"].tolist())

    known = sides(table)
    held = np.array([zlib.crc32(f"{seed}:{d}".encode()) % 5 for d in table["doc_id"]], int).reshape(-1) == 0
    # Per target and view: features, labels and weights of what it learns from.
    y = {t: table[t].to_numpy(float) for t in TARGETS}
    learnt = {(t, k): [(known[k][~held], y[t][~held], np.ones((~held).sum()))] for t in TARGETS for k in (0, 1)}
    check = held if held.any() else np.ones(len(table), bool)

    def scale_of(view: Linear, target: str, k: int) -> Linear:
        """The calibration of a view on the rows held out."""
        right = y[target][check]
        return Linear().fit(view.logit(known[k])[check][:, None], right, np.ones(len(right)), 1e-4) if len(right) else Linear(np.ones(1))

    def loss(view: Linear, target: str, k: int) -> np.ndarray:
        """Of the calibrated view on each row held out."""
        logit = scale_of(view, target, k).logit(view.logit(known[k])[check][:, None])
        return np.logaddexp(0, np.where(y[target][check] > 0, -logit, logit)) if check.any() else np.zeros(1)

    def worse(now: np.ndarray, before: np.ndarray) -> bool:
        """By more than the standard error of the mean difference: less is chance."""
        more = now - before
        return more.mean() > more.std() / np.sqrt(len(more))

    # Per target and view: its losses, the view itself, and how much of what it was handed it keeps.
    best: dict[tuple, tuple] = {}
    for turn in range(rounds + 1):
        for target in TARGETS:
            for k in (0, 1):
                x, label, weight = map(np.concatenate, zip(*learnt[target, k]))
                view = Linear().fit(x, label, weight) if len(x) else Linear(np.zeros(x.shape[1]))
                score = loss(view, target, k)
                if turn == 0 or not worse(score, best[target, k][0]):
                    best[target, k] = score, view, len(learnt[target, k])
                del learnt[target, k][best[target, k][2] :]
            model.views[target] = [(best[target, k][1], Linear(np.ones(1))) for k in (0, 1)]
        if turn < rounds:
            found = offers(model)
            for slot, own in found.groupby("slot"):
                target, k, value = TARGETS[slot // 4], slot // 2 % 2, slot % 2
                learnt[target, 1 - k].append((sides(own)[1 - k], np.full(len(own), float(value)), np.full(len(own), 0.5)))
    for target in TARGETS:
        views, right = [v for v, _ in model.views[target]], y[target][check]
        scales = [scale_of(v, target, k) for k, v in enumerate(views)]
        model.views[target] = list(zip(views, scales))
        calibrated = np.stack([s.logit(v.logit(x)[:, None]) for (v, s), x in zip(model.views[target], known)], axis=1)
        model.votes[target] = Linear().fit(np.clip(calibrated[check], -8, 8), right, np.ones(len(right)), 1e-4) if len(right) else Linear(np.ones(2))
    return model


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            if "text" in batch.schema.names:
                texts = batch.column("text").to_pylist()
                ids, page = [_chosen_in(model.value.chosen, t) for t in texts], np.array([page_of(t) for t in texts], float).reshape(-1, len(PAGE))
            else:
                ids, page = [np.frombuffer(x, np.int16) for x in batch.column("ids").to_pylist()], _pages(batch.column("page"))
            places = model.value.places(ids, page, lang, source)
            found = [pa.array(model.value.scores(t, places)) for t in TARGETS]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *found], ["row", *TARGETS])

    return score


def scored(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ("doc_id",), **settings) -> DataFrame:
    """``(row, quality, toxic, kept)`` per row of ``docs``: probabilities, and whether to keep it.

    ``row`` holds the ``carry`` columns. A row is kept if its quality is 0.5 or more and its
    toxicity below 0.5. Fitting collects a bounded sample of labelled rows and the surest of
    all others (``train``); every row is scored, from its stored digest unless it carries its
    text, which is then not stored a second time. Null and empty texts have no words and the
    layout of an empty page; null languages and sources are values of their own. Repeated
    rows get equal scores. Labels without id, or with a null, are left out; of several for
    one id the worse counts. Without any labels there is nothing to judge by: every
    probability is 0.5 and no row is kept.
    """
    again = "text" in carry
    model, digest = train(docs, labels, carry=() if again else carry, **settings)
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    rows = docs.select(row, "text", "lang", "source") if again else digest.select("row", "ids", "page", "lang", "source")
    fields = rows.schema["row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = rows.mapInArrow(_scorer(shared), f"row {fields}, quality double, toxic double")
    return out.withColumn("kept", F.expr("quality >= 0.5 AND toxic < 0.5"))
