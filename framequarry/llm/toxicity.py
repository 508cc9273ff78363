"""Toxicity by weak supervision.

Voters vote "toxic" where they see something and abstain elsewhere. Each word of a lexicon of insults is one; patterns
over the text are others (insults that are dense, near each other, of several kinds or next to "you"; shouting; repeated
marks; masked letters); and terms are mined, whole words and leading parts of words (stems) that occur once, twice or
more often, from a bounded set of labelled rows. A generative model with a hidden class then estimates, by expectation
maximisation over the votes alone, how often each voter is right, and from what the class leaves unexplained how the
voters are correlated: those that say the same of a document (a word, its stem, a pattern that needs it) share its weight. A logistic classifier over many more terms is trained on the resulting posterior labels, and its
threshold is set on the same bounded set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .text_kernels import U, chunks, prefix_hash, span_hash, string_bytes

#: Labelled rows that the model is fitted on, at most; taken by hash, so a larger table only adds choice.
MOST_LABELLED = 16_000
#: Of these, rows whose labels are used (to mine voters, to start the label model, for the threshold); the others are
#: learned from by their posterior labels only.
MOST_GOLD = 4_000
#: Terms of the linear classifier, and voters of the label model.
FEATURES, VOTERS = 2_048, 48
#: A term counts once more where a document has it twice, and again where it has it three times.
LEVELS = 3
#: Lengths in bytes of the leading parts of words that count as terms; 0 is the whole word.
STEMS = (0, 4, 5, 6, 7, 8)
#: A term votes if so many labelled documents have it and so large a share of them is toxic.
LEAST_DOCS, LEAST_SHARE = 4, 0.8
#: Insults that vote whether mined or not.
LEXICON = ("asshole", "bastard", "bitch", "clown", "coward", "crap", "cunt", "damn", "disgusting", "dumb", "fool", "freak", "fuck", "garbage", "hate", "idiot", "imbecile", "jerk", "kill", "liar", "loser", "moron", "pathetic", "pig", "scum", "shit", "sick", "slut", "stupid", "sucker", "trash", "ugly", "vermin", "whore", "worthless", "filth")
#: Weight of what is believed of a voter beforehand against what its votes tell.
BELIEF = 1.0
#: Log odds that a voter's silence takes off at most: it may know another language.
MUTE = -2.0
#: Words that address the reader.
ADDRESS = ("you", "your", "yours", "youre", "yourself", "u", "ur")
#: Patterns, in the order of ``patterns``.
PATTERNS = ("several insults", "dense", "near each other", "addressed", "shouting", "repeated marks", "masked letters")
#: Words between two insults that are near, and between an insult and whom it is said to; shouted words that count.
NEAR, BESIDE, SHOUTED = 40, 4, 3

_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_lo:_hi] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word: runs of ASCII letters, digits and non-ASCII bytes."""
    inside = _WORD[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts], after[cuts - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of all rows and the row of each."""
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64)
    starts, ends, rows = _words(data, offsets)
    sums = prefix_hash(data, True)
    hashes, of = [], []
    for k in STEMS:
        long = slice(None) if not k else ends - starts >= k
        s = starts[long]
        e = ends if not k else s + k
        hashes.append(span_hash(sums, s, e) ^ U(0xC2B2AE3D27D4EB4F if k else 0))
        of.append(rows[long])
    return np.concatenate(hashes), np.concatenate(of)


def patterns(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which of PATTERNS each row shows."""
    n = len(offsets) - 1
    out = np.zeros((n, len(PATTERNS)), bool)
    if not len(data):
        return out
    starts, ends, rows = _words(data, offsets)
    h = span_hash(prefix_hash(data, True), starts, ends)
    insult = np.flatnonzero(np.isin(h, [word_term(w) for w in LEXICON]))
    you = np.flatnonzero(np.isin(h, [word_term(w) for w in ADDRESS]))
    row, words = rows[insult], np.bincount(rows, minlength=n)
    found = np.bincount(row, minlength=n)
    kinds = np.unique(np.stack([row.astype(U), h[insult]], axis=1), axis=0)[:, 0].astype(np.int64)
    out[:, 0] = np.bincount(kinds, minlength=n) >= 2
    out[:, 1] = (found > 0) & (100 * found >= words)
    if len(insult) > 1:
        out[row[1:][(row[1:] == row[:-1]) & (np.diff(insult) <= NEAR)], 2] = True
    if len(you):
        for k in (-1, 0):
            at = you[np.clip(np.searchsorted(you, insult) + k, 0, len(you) - 1)]
            out[row[(np.abs(at - insult) <= BESIDE) & (rows[at] == row)], 3] = True
    upper = np.append(0, np.cumsum((data >= 65) & (data <= 90)))
    out[:, 4] = np.bincount(rows[(ends - starts >= 4) & (upper[ends] - upper[starts] == ends - starts)], minlength=n) >= SHOUTED
    at = np.flatnonzero((data[:-1] == 33) & np.isin(data[1:], (33, 63)))
    masked = 1 + np.flatnonzero(np.isin(data[1:-1], (35, 36, 42)) & _WORD[data[:-2]] & _WORD[data[2:]])
    for col, first, last in ((5, at, at + 1), (6, masked - 1, masked + 1)):
        of = np.searchsorted(offsets, first, "right") - 1
        out[of[of == np.searchsorted(offsets, last, "right") - 1], col] = True
    return out


def word_term(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(terms_of(data, np.array([0, len(data)]))[0][0])


def _counted(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each term once a row, with how often it occurs there."""
    by = np.lexsort((hashes, rows))
    h, r = hashes[by], rows[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    return h[at], r[at], np.diff(np.append(at, len(h)))


def _count(batches):
    """y, text -> term, level, clean, toxic: documents that have the term at least ``level`` times."""
    for batch in batches:
        offsets, data = string_bytes(batch.column(1))
        y = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in chunks(offsets, 1 << 20):
            part = offsets[a : b + 1]
            h, r, times = _counted(*terms_of(data[part[0] : part[-1]], part - part[0]))
            for level in range(1, LEVELS + 1):
                h, r, times = (x[times >= level] for x in (h, r, times))
                terms, at = np.unique(h, return_inverse=True)
                toxic = np.bincount(at, y[a:b][r], len(terms)).astype(np.int64)
                total = np.bincount(at, minlength=len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(np.full(len(terms), level, np.int32)), pa.array(total - toxic), pa.array(toxic)], names=["term", "level", "clean", "toxic"])


def present(data: np.ndarray, offsets: np.ndarray, known: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs: feature LEVELS * k + n for term ``known[k]`` that occurs more than n times.

    ``maybe`` marks the low 16 bits that occur among the known.
    """
    h, r = terms_of(data, offsets)
    some = maybe[(h & U(0xFFFF)).astype(np.int64)]
    h, r = h[some], r[some]
    at = np.searchsorted(known, h)
    hit = known[np.minimum(at, len(known) - 1)] == h
    pairs, times = np.unique(r[hit] * len(known) + at[hit], return_counts=True)
    rows, cols = pairs // len(known), pairs % len(known)
    deep = [times > n for n in range(LEVELS)]
    return np.concatenate([rows[d] for d in deep]), np.concatenate([cols[d] * LEVELS + n for n, d in enumerate(deep)])


def low_bits(known: np.ndarray) -> np.ndarray:
    maybe = np.zeros(1 << 16, bool)
    maybe[(known & U(0xFFFF)).astype(np.int64)] = True
    return maybe


def label_model(votes: np.ndarray, prior: float, share: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the hidden class for each row of 0/1 votes, and each voter's weight (log odds, correlation shared out).

    ``prior`` and ``share`` (of toxic among documents with the vote) start the estimation, and also count as much as
    BELIEF times the votes themselves: voters that never meet, as those of several languages, could belong
    to either class by their votes alone. A vote counts in full
    where it stands alone, and in part where voters that are correlated with it vote for the same row; voters that are
    correlated with others say less by their silence.
    """
    n, cast, given = len(votes), votes.sum(0), prior
    rate = votes.mean(0).clip(1 / (n + 2), 1 - 1 / (n + 2))
    hit = (rate * share / prior).clip(1e-3, 0.99)
    noise = (rate * (1 - share) / (1 - prior)).clip(1e-5, 0.99)
    post, by_class = np.full(n, prior), (rate, rate)
    for k in range(rounds):
        if k % 4 == 0:
            # what two voters have in common beyond the class they vote on; of the first, beyond what all have
            rest = votes - np.outer(post, by_class[0]) - np.outer(1 - post, by_class[1])
            cov = rest.T @ rest / n
            sd = np.sqrt(np.diag(cov)).clip(1e-9)
            tied = (cov / np.outer(sd, sd)).clip(0, 1)
            np.fill_diagonal(tied, 1.0)
            own, silence = votes / (votes @ tied).clip(1), 1 / tied.sum(1)
        on, off = np.log(hit / noise), np.log((1 - hit) / (1 - noise)).clip(MUTE)
        logit = np.log(prior / (1 - prior)) + (1 - votes) @ (off * silence) + own @ on
        post = 1 / (1 + np.exp(-logit.clip(-30, 30)))
        total = post.sum().clip(1e-9, n - 1e-9)
        prior = float(np.clip((total / n + BELIEF * given) / (1 + BELIEF), 1e-4, 0.9999))
        right = (post @ votes + BELIEF * share * cast) / (1 + BELIEF)
        hit = ((right + 0.5) / (total + 1)).clip(1e-5, 1 - 1e-5)
        noise = ((cast - right + 0.5) / (n - total + 1)).clip(1e-6, 1 - 1e-5)
        by_class = hit, noise
    return post, np.log(hit / noise) * own.sum(0) / cast.clip(1)


def choose_voters(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, m: int) -> np.ndarray:
    """Features that vote: often enough and right often enough, each the one that adds most to those before it.

    A toxic document that k voters already mark counts 2 ** -k, so stems of one word do not take all places.
    """
    total, toxic = np.bincount(cols, minlength=m), np.bincount(cols, y[rows], m)
    fit_to_vote = (toxic >= LEAST_DOCS) & (toxic >= LEAST_SHARE * total)
    mine = fit_to_vote[cols] & (y[rows] > 0)
    r, c = rows[mine], cols[mine]
    left, out = np.ones(len(y)), []
    price = 0.5 * (total - toxic)
    for _ in range(VOTERS):
        gain = np.where(fit_to_vote, np.bincount(c, left[r], m) - price, -1)
        best = int(np.argmax(gain))
        if gain[best] < 1:
            break
        out.append(best)
        fit_to_vote[best] = False
        left[r[c == best]] /= 2
    return np.array(out, np.int64)


def fit_linear(rows: np.ndarray, cols: np.ndarray, n: int, m: int, target: np.ndarray, rounds: int = 300, ridge: float = 2e-4) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels on 0/1 features, by Adam on the whole sample."""
    w, b = np.zeros(m), float(np.log(target.mean().clip(1e-4, 0.9999) / (1 - target.mean()).clip(1e-4)))
    m1, m2 = np.zeros(m + 1), np.zeros(m + 1)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(np.bincount(rows, w[cols], n) + b).clip(-30, 30)))
        gap = p - target
        grad = np.append(np.bincount(cols, gap[rows], m) / n + ridge * w, gap.mean())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        step = 0.1 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.999**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The cut of z with the best balance of precision and recall on labelled rows, in the middle of its gap."""
    by = np.argsort(-z, kind="stable")
    s, hits = z[by], np.cumsum(y[by])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + y.sum())
    last = np.append(s[1:] != s[:-1], True)
    best = int(np.argmax(np.where(last, f1, -1)))
    return float(s[best] + s[min(best + 1, len(s) - 1)]) / 2 if best + 1 < len(s) else float(s[-1]) - 1


class Model:
    """Sorted term hashes with LEVELS weights each; scores text without reading anything else."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, bias: float):
        self.known, self.weights, self.bias = known, weights, bias

    def scores(self, column) -> np.ndarray:
        offsets, data = string_bytes(column)
        out, maybe = np.full(len(offsets) - 1, self.bias), low_bits(self.known)
        for a, b in chunks(offsets):
            part = offsets[a : b + 1]
            if len(self.known):
                r, c = present(data[part[0] : part[-1]], part - part[0], self.known, maybe)
                out[a:b] += np.bincount(r, self.weights[c], b - a)
        return 1 / (1 + np.exp(-out.clip(-30, 30)))

    def score(self, text: Column) -> Column:
        """0 to 1; null counts as empty."""
        import pyarrow

        @F.arrow_udf("double")
        def scored(column: pa.Array) -> pa.Array:
            return pyarrow.array(self.scores(column))

        return scored(text)


def held_out(ident: Column) -> Column:
    """Whether crc32 of the identifier's text leaves 0 by 5; never so for null."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_LABELLED, most_gold: int = MOST_GOLD) -> Model:
    """Fit on at most ``most`` labelled rows that are not held out, the first by hash of their identifier.

    Labels of the first ``most_gold`` of them are used, the texts of all.

    Labels other than 0 and 1, null labels and labels without a document are ignored; of repeated labels the largest
    counts, of repeated identifiers one text. Without rows of both classes the score is the share of toxic labels.
    """
    y = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).filter("y in (0, 1) and id is not null")
    y = y.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y")).withColumn("place", F.xxhash64("id")).orderBy("place", "id").limit(most)
    texts = df.select(df[id_col].alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("t"))
    sample = materialise(texts.join(F.broadcast(y), "id").groupBy("id").agg(F.max("y").alias("y"), F.min("t").alias("t"), F.min("place").alias("place")), "labelled")
    last = sample.select("place").orderBy("place").limit(most_gold).agg(F.max("place")).first()[0]
    gold = sample.filter(F.col("place") <= F.lit(last))
    n, toxic = gold.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not toxic or toxic == n:
        discard(sample)
        share = (toxic / n) if n else 0.0
        return Model(np.zeros(0, U), np.zeros(0), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    counts = gold.select("y", "t").mapInArrow(_count, "term long, level int, clean long, toxic long").groupBy("term", "level").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("x"))
    # how far the term's counts are from those of the classes: the log likelihood ratio's leading part
    odds = F.log((F.col("x") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (n - toxic + 1))
    top = counts.filter(F.col("c") + F.col("x") >= LEAST_DOCS).withColumn("g", F.abs(odds) * F.sqrt(F.col("x") + F.col("c") * (toxic / n))).orderBy(F.desc("g"), "term", "level").limit(FEATURES).collect()
    top = sorted(top, key=lambda r: (-r.g, r.term, r.level))
    known = np.array(sorted({r.term & (1 << 64) - 1 for r in top} | {word_term(w) for w in LEXICON}), U)
    rank = {int(t): k for k, t in enumerate(known)}

    def features(batches):
        maybe = low_bits(known)
        for batch in batches:
            offsets, data = string_bytes(batch.column(1))
            lists, seen = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            for a, b in chunks(offsets):
                part = offsets[a : b + 1] - offsets[a]
                own = data[offsets[a] : offsets[b]]
                for r, c in zip(*(x.tolist() for x in present(own, part, known, maybe)), strict=True):
                    lists[a + r].append(c)
                for r, c in zip(*(x.tolist() for x in np.nonzero(patterns(own, part))), strict=True):
                    seen[a + r].append(c)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32())), pa.array(seen, pa.list_(pa.int32()))], names=["y", "f", "p"])

    labelled = F.when(F.col("place") <= F.lit(last), F.col("y"))
    got = sample.select(labelled.alias("y"), "t").mapInArrow(features, "y int, f array<int>, p array<int>").collect()  # bounded by ``most``
    discard(sample)
    flat = lambda lists: (np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([c for x in lists for c in x], np.int64))
    is_gold = np.array([r.y is not None for r in got])
    y = np.array([r.y or 0 for r in got], float)
    rows, cols = flat([r.f for r in got])

    mine = is_gold[rows]
    chosen = choose_voters(rows[mine], cols[mine], y, len(known) * LEVELS)
    listed = np.array([rank[word_term(w)] * LEVELS for w in LEXICON])
    voters = np.concatenate([listed, np.setdiff1d(chosen, listed)])
    votes = np.zeros((len(got), len(voters) + len(PATTERNS)))
    voter_of = np.full(len(known) * LEVELS, -1)
    voter_of[voters] = np.arange(len(voters))
    at = voter_of[cols]
    votes[rows[at >= 0], at[at >= 0]] = 1
    seen_rows, seen = flat([r.p for r in got])
    votes[seen_rows, len(voters) + seen] = 1
    votes = votes[:, votes.sum(0) >= LEAST_DOCS]  # the others have nothing to learn from
    share = (votes[is_gold].T @ y[is_gold] + 0.5) / (votes[is_gold].sum(0) + 1)
    post, _ = label_model(votes, toxic / n, share)
    weights, bias = fit_linear(rows, cols, len(got), len(known) * LEVELS, post)
    z = np.bincount(rows, weights[cols], len(got)) + bias
    return Model(known, weights, bias - threshold(z[is_gold], y[is_gold]))


def toxicity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Null texts count as empty, and empty ones are scored too. Texts are read whole, however long. A null identifier
    stays null and is not held out; rows that repeat have the score of their text. Other columns, whatever their names,
    are not read. Empty input gives no rows.
    """
    scored = df.select(df[id_col].alias("i"), model.score(df[text_col].cast("string")).alias("score"))
    return scored.select(F.col("i").alias(id_col), held_out(F.col("i")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
