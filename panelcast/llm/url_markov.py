"""URL filter by the ratio of two character language models.

Rules (host, path) decide the urls they fit: the host itself and its
subdomains, where the url's path begins with the rule's; the longest rule
wins.  What they allow and block teaches two Markov models of variable order,
one of accepted and one of rejected urls, and these judge all other urls.

* A url is its UTF-8 bytes between a start and an end mark.  A context is the
  last k symbols, k from 0 to ``ORDER``.  A model predicts a symbol from the
  longest context it holds, smoothed over all shorter ones (Witten-Bell; below
  order 0 all symbols are equally likely), so its order varies from place to
  place.
* Contexts are counted over all distinct urls that a rule decides, by
  ``groupBy`` after each batch has summed its own.  Contexts seen fewer than
  ``LEAST`` times are no part of the models; all others are, however many.
* The commonest contexts are broadcast, at most ``ENTRIES`` (context, symbol)
  pairs: the limit of how often they are seen is doubled until they fit.  The
  rest of the models stays a table.  The places of a url whose context may go
  on in it are joined with it by context, and what its longer contexts change
  is added to the score, which is that of the whole models.
* A fifth of the distinct ruled urls, by their hash, is kept from counting and
  calibrates the score: the difference of the two log-likelihoods, divided by
  the number of predicted symbols.  A logistic curve is fitted to it, both
  classes weighing the same, from counts over bins of the score.  A url is
  blocked where its chance of being accepted is under a half.

Defined results: a null url has an empty host and path, fits no rule and is
judged as the empty text; so is a url without ``://`` as to host and path, but
judged by its text; without any ruled url the method allows everything;
without ruled urls of one class that class's model holds every symbol equally
likely; a class without calibrating urls leaves the curve at slope 1 through
0; repeated rows get the same verdict each; an empty table gives no rows;
further columns are kept by ``keep_allowed`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import binary_views, boxed, checkpointed, mix64, slices

#: The rules of the query: fixed values.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

ORDER = 5
LEAST = 2
ENTRIES = 1 << 20
CALIBRATE_ONE_OF = 5
BINS, WIDEST = 4_096, 8.0
END, START, SYMBOLS = 256, 257, 257
PART = 1 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, parts, 2)


def decided(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, the first in byte order among equally long ones; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(verdict)
    return rule, verdict


def contexts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(symbol, url number, one context hash per order, place in the url) of every predicted symbol.

    The hash of order k takes one more symbol to the left than that of order
    k - 1; a context does not reach over the start of its url, places of which
    it would be asked carry the place's longest context instead.
    """
    n = len(offs) - 1
    lengths = np.diff(offs) + 2
    ends = np.cumsum(lengths)
    marks = np.full(int(ends[-1]) if n else 0, START, np.int64)
    own = np.repeat(np.arange(n), lengths)
    place = np.arange(len(marks)) - np.repeat(ends - lengths, lengths)
    inside = (place > 0) & (place < np.repeat(lengths - 1, lengths))
    marks[inside] = data[offs[0]:offs[-1]]
    marks[ends - 1] = END
    asked = np.flatnonzero(place > 0)
    hashes = [np.zeros(len(asked), np.uint64)]
    for k in range(1, ORDER + 1):
        left = marks[np.maximum(asked - k, 0)].astype(np.uint64) + np.uint64(1 + 512 * k)
        hashes.append(np.where(place[asked] >= k, mix64(hashes[-1] ^ mix64(left)), hashes[-1]))
    return marks[asked], own[asked], hashes, place[asked]


def pair_key(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return mix64(context + np.uint64(0x9E3779B97F4A7C15) * (symbol.astype(np.uint64) + np.uint64(1)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(context, symbol, accepted, rejected) summed within parts of a batch."""
    for b in batches:
        data, offs, _ = binary_views(b.column("url"))
        bad = np.asarray(b.column("rejected"))
        for i, j in slices(offs, PART // 8):
            symbol, own, hashes, place = contexts(data, offs[i:j + 1])
            for k, h in enumerate(hashes):
                use = place >= k
                key = np.empty(int(use.sum()), [("c", np.uint64), ("s", np.int64)])
                key["c"], key["s"] = h[use], symbol[use]
                pair = pair_key(key["c"], key["s"])
                _, first, inverse = np.unique(pair, return_index=True, return_inverse=True)
                wrong = bad[i:j][own[use]]
                all_of, bad_of = np.bincount(inverse, minlength=len(first)), np.bincount(inverse, weights=wrong, minlength=len(first)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "context": pa.array(key["c"][first].view(np.int64)), "symbol": pa.array(key["s"][first].astype(np.int32)),
                    "accepted": pa.array(all_of - bad_of), "rejected": pa.array(bad_of)})


class Model:
    """Both Markov models as sorted arrays: context sums and kinds of symbols, and pair counts.

    ``rest`` is the table of the contexts that the arrays have no room for
    (context, sums and kinds per class, counts: symbol -> counts), None if there are none.
    """

    rest: DataFrame | None = None

    def __init__(self, context: np.ndarray, symbol: np.ndarray, counts: np.ndarray):
        self.contexts, where = np.unique(context, return_inverse=True)
        self.sums = np.stack([np.bincount(where, weights=counts[c], minlength=len(self.contexts)) for c in (0, 1)])
        self.kinds = np.stack([np.bincount(where, weights=counts[c] > 0, minlength=len(self.contexts)) for c in (0, 1)])
        keys = pair_key(context, symbol)
        order = np.argsort(keys)
        self.pairs, self.counts = keys[order], counts[:, order].astype(np.float64)

    def chances(self, symbol: np.ndarray, hashes: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chance of every symbol in both models, the number of its contexts that the arrays hold)."""
        p = np.full((2, len(symbol)), 1.0 / SYMBOLS)
        held = np.ones((2, len(symbol)), bool)
        depth = np.zeros(len(symbol), np.int64)
        for k, h in enumerate(hashes if len(self.contexts) else []):
            at = np.minimum(np.searchsorted(self.contexts, h), len(self.contexts) - 1)
            known = (self.contexts[at] == h) & (place >= k)
            depth += known & (depth == k)
            key = pair_key(h, symbol)
            to = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            seen = self.pairs[to] == key
            for c in (0, 1):
                held[c] &= known & (self.sums[c, at] > 0)
                n, t = self.sums[c, at], self.kinds[c, at]
                p[c] = np.where(held[c], (np.where(seen, self.counts[c, to], 0.0) + t * p[c]) / np.maximum(n + t, 1.0), p[c])
        return p, depth

    def difference(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Each url's log-likelihood as accepted less that as rejected, per predicted symbol."""
        symbol, own, hashes, place = contexts(data, offs)
        p, _ = self.chances(symbol, hashes, place)
        total = np.bincount(own, weights=np.log(p[0]) - np.log(p[1]), minlength=len(offs) - 1)
        return total / np.maximum(np.bincount(own, minlength=len(offs) - 1), 1)

    def scores(self, urls: pa.Array) -> np.ndarray:
        data, offs, _ = binary_views(urls)
        parts = [self.difference(data, offs[i:j + 1]) for i, j in slices(offs, PART // 8)]
        return np.concatenate(parts) if parts else np.zeros(0)


def fit_model(ruled: DataFrame, least: int = LEAST, entries: int = ENTRIES) -> Model:
    """The two models of ``ruled`` (url, rejected): arrays of at most ``entries`` pairs, the others in the table ``rest``."""
    pairs = checkpointed(ruled.mapInArrow(_counted, "context long, symbol int, accepted long, rejected long")
                         .groupBy("context", "symbol").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")))
    sums = pairs.groupBy("context").agg(F.greatest(F.sum("accepted"), F.sum("rejected")).alias("seen"), F.count("*").alias("pairs"))
    # by powers of two of the count: at most 63 rows
    sizes = {r.power: r.pairs for r in sums.filter(F.col("seen") >= least)
             .groupBy(F.floor(F.log2(F.col("seen") / least)).cast("int").alias("power")).agg(F.sum("pairs").alias("pairs")).collect()}
    power = 0
    while sum(n for k, n in sizes.items() if k >= power) > entries:
        power += 1
    kept = sums.filter(F.col("seen") >= least * 2 ** power).select("context")
    t = pairs.join(kept, "context").toArrow()
    counts = np.stack([t.column(c).to_numpy() for c in ("accepted", "rejected")]).astype(np.int64)
    model = Model(t.column("context").to_numpy().astype(np.int64).view(np.uint64), t.column("symbol").to_numpy().astype(np.int64), counts)
    if power:
        count, seen = F.struct("accepted", "rejected"), F.greatest("sums.accepted", "sums.rejected")
        model.rest = checkpointed(pairs.groupBy("context").agg(
            F.struct(*[F.sum(c).alias(c) for c in ("accepted", "rejected")]).alias("sums"),
            F.struct(*[F.count_if(F.col(c) > 0).alias(c) for c in ("accepted", "rejected")]).alias("kinds"),
            F.map_from_entries(F.collect_list(F.struct("symbol", count))).alias("counts"))  # at most SYMBOLS entries
            .filter((seen >= least) & (seen < least * 2 ** power)))
    return model


def fit_curve(middles: np.ndarray, accepted: np.ndarray, rejected: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(slope, offset) of the logistic curve for the chance of being accepted, both classes weighing the same."""
    if not accepted.sum() or not rejected.sum():
        return 1.0, 0.0
    up, down = accepted / accepted.sum(), rejected / rejected.sum()
    hi, lo = 1 - 1 / (accepted.sum() + 2), 1 / (rejected.sum() + 2)  # targets short of 1 and 0
    weight, target = up + down, up * hi + down * lo
    x = np.stack([middles, np.ones_like(middles)])
    w = np.array([1.0, 0.0])
    for _ in range(steps):  # Newton
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        grad = x @ (weight * p - target) + 1e-6 * w
        hess = (x * (weight * p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _sent(df: DataFrame, model: Model):
    """The arrays of the model, broadcast plain: a broadcast class would have to be installed there."""
    return df.sparkSession.sparkContext.broadcast({name: x for name, x in vars(model).items() if name != "rest"})


def _received(sent) -> Model:
    model = Model.__new__(Model)
    model.__dict__.update(sent.value)
    return model


def _scorer(sent):
    """A column function: the score of a url by the arrays of the model."""
    @F.arrow_udf("double")
    def score(url: pa.Array) -> pa.Array:
        return pa.array(_received(sent).scores(url), pa.float64())
    return score


def _open_places(sent):
    """(url id, symbols of the url, place, order, context, symbol, both chances) of the contexts that the arrays don't hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _received(sent)
        for b in batches:
            data, offs, _ = binary_views(b.column("url"))
            for i, j in slices(offs, PART // 8):
                symbol, own, hashes, place = contexts(data, offs[i:j + 1])
                p, depth = model.chances(symbol, hashes, place)
                sizes = np.bincount(own, minlength=j - i)
                for k, h in enumerate(hashes):
                    use = np.flatnonzero((depth <= k) & (place >= k))
                    yield pa.RecordBatch.from_pydict({
                        "id": b.column("id").take(pa.array(own[use] + i)), "symbols": pa.array(sizes[own[use]]),
                        "place": pa.array(place[use]), "order": pa.array(np.full(len(use), k, np.int32)),
                        "context": pa.array(h[use].view(np.int64)), "symbol": pa.array(symbol[use].astype(np.int32)),
                        "accepted": pa.array(p[0, use]), "rejected": pa.array(p[1, use])})
    return run


def _by_rest(asked: DataFrame, model: Model, sent) -> DataFrame:
    """(id, more): what the contexts of ``model.rest`` add to the score of each of ``asked`` (id, url), for urls that hold any.

    A context is in the models only with all shorter ones, so those of a place
    that the table holds follow the ones of the arrays without a gap.  A
    context that many urls share is split by the planner's handling of skew.
    """
    places = asked.mapInArrow(_open_places(sent), "id binary, symbols long, place long, order int, context long, symbol int, accepted double, rejected double")
    met = places.join(model.rest, "context")
    own = F.element_at("counts", F.col("symbol"))
    step = F.struct("order", "sums", "kinds", own.alias("own"))
    met = met.groupBy("id", "place").agg(F.max("symbols").alias("symbols"), F.max("accepted").alias("accepted"),
                                         F.max("rejected").alias("rejected"), F.sort_array(F.collect_list(step)).alias("steps"))  # at most ORDER + 1

    def end(c: str) -> Column:
        return F.aggregate("steps", F.col(c), lambda p, s: F.when(
            s["sums"][c] > 0, (F.coalesce(s["own"][c], F.lit(0)) + s["kinds"][c] * p) / (s["sums"][c] + s["kinds"][c])).otherwise(p))
    change = F.log(end("accepted") / F.col("accepted")) - F.log(end("rejected") / F.col("rejected"))
    return met.select("id", "symbols", change.alias("change")).groupBy("id").agg((F.sum("change") / F.max("symbols")).alias("more"))


def with_score(df: DataFrame, model: Model, url: str) -> DataFrame:
    """``df`` with ``score``, that of its column ``url`` by the whole models; null where that is null."""
    sent = _sent(df, model)
    asked = F.when(F.col(url).isNotNull(), _scorer(sent)(F.col(url)))
    if model.rest is None:
        return df.withColumn("score", asked)
    key = F.unhex(F.md5(F.col(url)))
    more = _by_rest(df.filter(F.col(url).isNotNull()).select(key.alias("id"), F.col(url).alias("url")).distinct(), model, sent)
    both = df.select(boxed(df).alias("all"), asked.alias("score"), key.alias("id")).join(more, "id", "left")
    return both.select("all.*", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """(row: the columns of ``pages``, host, path, rule, verdict, score, p_accept); the last two are null where a rule decides."""
    text = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    urls = pages.select(text.alias("url"))
    host, path = host_and_path(F.col("url"))
    rule, verdict = decided(host, path, rules)
    ruled = urls.select("url", (verdict == "block").alias("rejected")).filter(F.col("rejected").isNotNull()).distinct()
    fold = F.pmod(F.xxhash64("url"), F.lit(CALIBRATE_ONE_OF)) == 0
    model = fit_model(ruled.filter(~fold))
    width = 2 * WIDEST / BINS
    at = F.least(F.greatest(F.floor((F.col("score") + WIDEST) / width), F.lit(0)), F.lit(BINS - 1))
    rows = with_score(ruled.filter(fold), model, "url").groupBy(at.alias("bin"), "rejected").count().collect()  # at most 2 x BINS rows
    tally = np.zeros((2, BINS))
    for r in rows:
        tally[int(r.rejected), r.bin] += r["count"]
    slope, offset = fit_curve((np.arange(BINS) + 0.5) * width - WIDEST, tally[0], tally[1])
    ahead = pages.select(boxed(pages).alias("row"), text.alias("url"))
    ahead = ahead.select("row", "url", host.alias("host"), path.alias("path"))
    rule, verdict = decided(F.col("host"), F.col("path"), rules)
    ahead = ahead.select("row", "url", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    scored = with_score(ahead.withColumn("asked", F.when(F.col("rule").isNull(), F.col("url"))), model, "asked")
    chance = 1 / (1 + F.exp(-(F.col("score") * slope + offset)))
    scored = scored.withColumn("p_accept", chance)
    by_method = F.when(F.col("p_accept") < 0.5, "block").otherwise("allow")
    return scored.select("row", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), "score", "p_accept")


def judge_pages(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, p_accept) of every page."""
    out = judged(pages.select("page_id", "url"))
    return out.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict", "score", "p_accept")


def keep_allowed(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """The rows of ``pages`` whose url is allowed, with their columns."""
    return judged(pages, rules, url).filter(F.col("verdict") == "allow").select("row.*")
