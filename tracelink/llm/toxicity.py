"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The kernel of two strings sums, over all common subsequences of ``ORDER`` characters with at most ``REACH`` - 1 characters skipped
between neighbours and none after a word's start, decay to the power of the characters skipped in both strings; so a gapped or padded insult still shares most of its
subsequences with the plain one. A sentence's value for a landmark is the largest kernel value of any of its places with it (a word between
its ends, a part of a word between inner signs, a window of a long word), as a share of the landmark's own. Landmarks come
from both classes: word starts and words that mark toxic documents, the clean words that come closest
to them, and the first letters of insults. The values are whitened with the landmarks' own kernel matrix (Nyström). The machine is trained on the places
of labelled sentences, each distinct place once, as a sentence is as toxic as its most toxic place: all places of clean documents' sentences are clean, and of toxic documents those
are toxic that the machine itself finds so (chosen anew in each of a few rounds). Two kinds of made places join them, with weights of their own: copies of insults in which
characters are inserted, doubled or set apart, and other words near an insult (closer, idiom), with letters before it, another ending, or other letters in one place. A
document scores as its most toxic sentence, through a logistic curve. Characters without width do not count, and a word with signs inside is also
read without them.

The kernel is computed exactly and for all words: a table has a row for each subsequence of any landmark, and a
word's subsequences are looked up in it, so what shares none costs a look-up.

Training reads at most ``per_class`` toxic and ``clean_ratio`` times as many clean labelled documents (smallest hash of
doc_id; of rows that share it, that with the smallest hash of its text), only rows whose crc32 of the doc_id as text
is not divisible by 5. Inputs of a score are texts alone. Scoring covers every word of every text.

Edge cases: a null or empty text scores as a text without any landmark; labels that repeat count as
toxic if one of them does, null labels are not used; without labels of both classes every score is
the share of toxic labels; repeated rows give repeated rows; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import gc
import random
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.llm.common import release, sized, strings, texts_of

#: Characters of a subsequence, weight of a skipped character, and places from one character to the next at most.
ORDER, DECAY, REACH = 4, 0.8, 3
START, END = b"^", b"$"
#: Characters of a window of a long word, and from one window to the next.
WINDOW, STRIDE = 24, 14
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]_`{|}~¡¿«»“”„’‘…–—"
#: Characters without width.
UNSEEN = r"[\x{AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]"
SPACED = r"(?:^|\s)(?:[^\s][\s.\-_*]{1,3}){3,}[^\s](?:\s|$)"
_spaced = re.compile(r"(?:(?<=\s)|^)(?:[^\s][\s.\-_*]{1,3}){3,}[^\s](?=\s|$)")
INNER = re.compile(rb"[^0-9a-z\x80-\xff]+")


class Landmarks:
    """Landmark strings and the kernel values of words against them."""

    def __init__(self, strings_: list[bytes], starts: list[bytes] = ()) -> None:
        """``starts`` are further landmarks, which a word cannot be like alone."""
        self.leading = len(strings_)
        strings_ = [*strings_, *starts]
        self.strings = strings_
        used = sorted(set(b"".join(strings_)))
        self.code = np.zeros(256, np.int32)  # 0: in no landmark, so in no common subsequence
        self.code[used] = np.arange(1, len(used) + 1)
        self.base = len(used) + 1
        rows: dict[int, dict[int, float]] = defaultdict(dict)
        self.known = [np.zeros(self.base**n, bool) for n in range(2, ORDER)]  # starts of some landmark's subsequences
        flat, owner = self._stream(strings_)
        for j, key, w in self._subsequences(flat, owner):
            for i, k in zip(j.tolist(), key.tolist(), strict=True):
                rows[k][i] = rows[k].get(i, 0.0) + w
        self.row = np.full(self.base**ORDER, -1, np.int32)
        self.row[list(rows)] = np.arange(len(rows))
        for n, known in enumerate(self.known, 2):
            known[np.array(list(rows), np.int64) // self.base ** (ORDER - n)] = True
        self.weights = np.zeros((len(rows), len(strings_)), np.float32)
        for r, own in enumerate(rows.values()):
            self.weights[r, list(own)] = list(own.values())
        gram = self.kernel(strings_).astype(np.float64)
        self.own = np.maximum(np.diag(gram), 1e-9)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2 / np.sqrt(np.outer(self.own, self.own)))
        keep = values > 1e-3
        self.whiten = vectors[:, keep] / np.sqrt(values[keep])

    def _stream(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' character codes, too far apart for a subsequence to cross, and the word of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + REACH
        flat = self.code[np.frombuffer((b"\0" * REACH).join([*words, b""]), np.uint8)]
        return flat, np.repeat(np.arange(len(words)), sizes)

    def _subsequences(self, flat: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Word, number and weight of all subsequences, in parts of one shape, words in order; once ``known`` is
        filled, of those whose start some landmark has."""
        flat = np.concatenate([flat, np.zeros(REACH * ORDER, flat.dtype)])
        base, opening = self.base, self.code[START[0]]

        def grow(at: np.ndarray, key: np.ndarray, end: int, n: int, skipped: int) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
            for step in range(1, REACH + 1):
                next_ = flat[at + (end + step)]
                longer = key * base + next_
                keep = next_ > 0
                if n == 1 and step > 1 and opening:
                    keep &= key != opening  # a word's first character follows its start
                if n + 1 < ORDER and self.known[n - 1].any():
                    keep &= self.known[n - 1][longer]
                some = np.flatnonzero(keep)
                if not len(some):
                    continue
                if n + 1 == ORDER:
                    yield owner[at[some]], longer[some], DECAY ** (skipped + step - 1)
                else:
                    yield from grow(at[some], longer[some], end + step, n + 1, skipped + step - 1)

        at = np.flatnonzero(flat)
        yield from grow(at, flat[at].astype(np.int64), 0, 1, 0)

    def kernel(self, words: list[bytes]) -> np.ndarray:
        """Kernel of each word with each landmark."""
        out = np.zeros((len(words), len(self.strings)), np.float32)
        for lo in range(0, len(words), 4000):
            flat, owner = self._stream(words[lo : lo + 4000])
            for word, key, weight in self._subsequences(flat, owner):
                row = self.row[key]
                some = np.flatnonzero(row >= 0)
                if not len(some):
                    continue
                word, row = word[some], row[some]
                first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
                out[lo + word[first]] += np.float32(weight) * np.add.reduceat(self.weights[row], first, axis=0)
        return out

    def __call__(self, words: list[bytes], least: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words that reach ``least`` with some landmark, and all their values: shares of the landmarks' own."""
        pieces: list[bytes] = []
        owner: list[int] = []

        def add(w: bytes, i: int) -> None:
            whole = START + w + END
            for at in [0] if len(whole) <= WINDOW else range(0, len(whole) - WINDOW + STRIDE, STRIDE):
                pieces.append(whole[at : at + WINDOW])
                owner.append(i)

        for i, w in enumerate(words):
            add(w, i)
            if not w.isalnum() and len(parts := INNER.split(w)) > 1:
                for p in {*parts, b"".join(parts)}:  # each part, and all as if the signs were not there
                    if len(p) >= ORDER and p != w:
                        add(p, i)
        value = np.minimum(1, self.kernel(pieces) / self.own.astype(np.float32))
        own = np.asarray(owner, np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1]) if len(own) else np.zeros(0, np.int64)
        pooled = np.maximum.reduceat(value, first, axis=0) if len(own) else value
        hits = np.flatnonzero(pooled[:, : self.leading].max(axis=1, initial=0) >= least)
        return own[first][hits], pooled[hits]


class Words:
    """The words of a batch of texts, with document and sentence of each. Words end at any white space."""

    def __init__(self, texts: pa.Array) -> None:
        low = pc.replace_substring_regex(pc.utf8_lower(texts), pattern=UNSEEN, replacement="")
        spaced = pc.match_substring_regex(low, pattern=SPACED)
        if pc.any(spaced).as_py():  # letters set apart are read together as well
            runs = [[re.sub(r"[\s.\-_*]", "", m) for m in _spaced.findall(t)] for t in low.filter(spaced).to_pylist()]
            # the first letter may be a word of its own (a m o r o n)
            joined = [t + " . " + " ".join(x for m in own for x in (m, m[1:])) for t, own in zip(low.filter(spaced).to_pylist(), runs, strict=True)]
            low = pc.replace_with_mask(low, spaced, pa.array(joined, low.type))
        low = pc.replace_substring(low, pattern="\n", replacement=" . ")
        low = pc.replace_substring_regex(low, pattern=r"[\t\r\v\f\x1c-\x1f\x{85}\pZ]", replacement=" ")
        lists = pc.split_pattern(low, " ")
        coded = lists.flatten().dictionary_encode()
        starts = np.asarray(lists.offsets, np.int64)
        self.codes = np.asarray(coded.indices)
        self.document = np.repeat(np.arange(len(texts)), np.diff(starts))
        last = pc.utf8_slice_codeunits(coded.dictionary, -1)
        ends = np.asarray(pc.is_in(last, value_set=pa.array([".", "!", "?"], last.type)))[self.codes]
        self.sentence = np.cumsum(np.concatenate([[0], ends[:-1]])) + self.document if len(ends) else np.zeros(0, np.int64)
        self.words = [w.encode() for w in strings(pc.utf8_trim(coded.dictionary, characters=PUNCTUATION))]

    def hits(self, landmarks: Landmarks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, sentence and value row of each word that is like some landmark, and the rows."""
        own, values = landmarks(self.words)
        place = np.full(len(self.words), -1)
        place[own] = np.arange(len(own))
        row = place[self.codes]
        at = np.flatnonzero(row >= 0)
        return self.document[at], self.sentence[at], row[at], values


def support_vector_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Weights (the last one the bias) of a linear machine with squared hinge loss, by Newton steps; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    own = np.full(x.shape[1], ridge)
    own[-1] = 1e-9
    loss = lambda v: own @ (v * v) / 2 + weight @ np.maximum(0, 1 - y * (x @ v)) ** 2 / 2
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        active = y * (x @ w) < 1
        xa, ca = x[active], weight[active]
        step = np.linalg.solve(np.diag(own + 1e-9) + (xa * ca[:, None]).T @ xa, own * w - xa.T @ (ca * (y[active] - xa @ w)))
        rate = 1.0
        while loss(w - rate * step) > loss(w) and rate > 1e-4:
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-8:
            break
    return w


def logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of P(y = 1 | f), fitted by Newton steps on smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    c = np.full(len(y), 1 / len(y))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
        g = np.array([((p - t) * c * f).sum() + 1e-3 * a, ((p - t) * c).sum()])
        h = c * p * (1 - p)
        hess = np.array([[(h * f * f).sum() + 1e-3, (h * f).sum()], [(h * f).sum(), h.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, g), -2, 2)
        a, b = max(1e-3, a - step[0]), b - step[1]
    return float(a), float(b)


def _starts(words: set[bytes]) -> set[bytes]:
    """Word starts of 4 to 9 bytes, and whole words of 3 to 14."""
    return {START + w[:k] for w in words for k in range(4, min(len(w), 9) + 1)} | {START + w + END for w in words if 3 <= len(w) <= 14}


def choose_landmarks(docs: list[set[bytes]], toxic: np.ndarray, most: int, need: int = 6) -> list[bytes]:
    """Word starts and whole words that mark toxic documents, none the start of another.

    One is of use if ``need`` toxic documents have it, copies of each other not counted, and hardly a clean one (a
    fiftieth of its share among the toxic). Counts of hashes go first, so only strings that can be of use are held.
    """
    positive = int(toxic.sum())
    need = max(need, positive // 33)  # what few documents have may be the habit of their author
    slots = np.zeros(1 << 22, np.int32)
    for i in np.flatnonzero(toxic):
        own = np.fromiter({zlib.crc32(s) & 0x3FFFFF for s in _starts(docs[i])}, np.int64)
        slots[own] += 1
    held: dict[bytes, list[int]] = defaultdict(list)
    for i in np.flatnonzero(toxic).tolist():
        for s in _starts(docs[i]):
            if slots[zlib.crc32(s) & 0x3FFFFF] >= need:
                held[s].append(i)
    held = {s: ids for s, ids in held.items() if len(ids) >= need}
    clean: Counter = Counter()
    for i in np.flatnonzero(toxic == 0):
        clean.update(s for s in _starts(docs[i]) if s in held)
    scale = positive / max(1, len(docs) - positive)
    able = sorted((s for s, ids in held.items() if clean[s] * scale <= 0.02 * len(ids)), key=lambda s: (-len(held[s]) * (1 + 0.05 * len(s)), s))
    chosen: list[bytes] = []
    told: set[int] = set()  # documents that a landmark explains
    for s in able:
        stem = s.rstrip(END)
        if len(chosen) >= most or any(stem.startswith(x.rstrip(END)) or x.rstrip(END).startswith(stem) for x in chosen):
            continue
        # what few documents have, all of which another landmark explains, is chance
        if (len(held[s]) >= 0.05 * positive or len(set(held[s]) - told) >= need) and _differ(docs, held[s], need):
            chosen.append(s)
            told.update(held[s])
    return chosen


def _differ(docs: list[set[bytes]], ids: list[int], need: int) -> bool:
    """Whether ``need`` of the documents share less than a third of their words with each other."""
    kept: list[set[bytes]] = []
    for i in ids:
        own = docs[i]
        if all(4 * len(own & k) < len(own) + len(k) for k in kept):
            kept.append(own)
            if len(kept) >= need:
                return True
    return False


def clean_landmarks(words: list[bytes], values: np.ndarray, clean: np.ndarray, most: int) -> list[bytes]:
    """The clean words that come closest to toxic landmarks, at most two for each of these."""
    taken: Counter = Counter()
    out: list[bytes] = []
    top, which = values.max(axis=1), values.argmax(axis=1)
    for i in sorted(np.flatnonzero(clean & (top > 0.35)).tolist(), key=lambda i: (-top[i], words[i])):
        if taken[which[i]] < 2 and len(out) < most and len(words[i]) <= WINDOW - 2:
            taken[which[i]] += 1
            out.append(START + words[i] + END)
    return out


def disguises(word: bytes, rng: random.Random) -> list[bytes]:
    """Copies of a word with characters inserted, doubled or set apart; letters most of all, as signs inside a word are read over."""
    letter = lambda: bytes([rng.randrange(97, 123)])
    out = [b".".join(word[i : i + 1] for i in range(len(word))), letter().join(word[i : i + 1] for i in range(len(word)))]
    for at in range(1, len(word)):
        out += [word[:at] + inserted + word[at:] for inserted in (b"*", letter(), letter(), letter(), b"x", word[at - 1 : at])]
        if at % 2:
            out.append(word[:at] + letter() + letter() + word[at:])
    return out


def lookalikes(word: bytes, rng: random.Random) -> list[bytes]:
    """Other words that share much with a word: letters before it, another ending, other letters in one place. Everyday words
    near an insult (closer, idiom, morning) are of this kind, whether or not the labelled texts have them."""
    letters = lambda n: bytes(rng.choice(b"eeeetttaaooiinnssrrhhldcumfpgwybvk") for _ in range(n))
    out = [letters(n) + word for n in (1, 1, 2, 3, 4)] + [word + letters(n) for n in (3, 4)]
    for at in range(len(word)):
        out.append(word[:at] + letters(1) + word[at + 1 :])
        out.append(word[:at] + letters(2) + word[at + 2 :])
        if at >= 2:
            out += [word[:at] + letters(n) for n in (2, 3, 4)]
    return [w for w in out if not w.startswith(word[:-1]) or len(w) > len(word) + 1]


class Model:
    """A trained scorer."""

    def __init__(self, landmarks: Landmarks | None, weights: np.ndarray | None, slope: float, offset: float) -> None:
        self.landmarks, self.weights, self.slope, self.offset = landmarks, weights, slope, offset

    def scores(self, texts: pa.Array) -> np.ndarray:
        """A score from 0 to 1 of each text."""
        best = self.decisions(texts)
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.offset, -700, 700)))

    def decisions(self, texts: pa.Array) -> np.ndarray:
        """The machine's value of each text's most toxic place."""
        if self.landmarks is None:
            return np.zeros(len(texts))
        best = np.full(len(texts), self.weights[-1])
        document, _, row, values = Words(texts).hits(self.landmarks)
        np.maximum.at(best, document, (values @ (self.landmarks.whiten @ self.weights[:-1]) + self.weights[-1])[row])
        return best

    def sentences(self, text: str) -> list[float]:
        """Scores of a text's sentences, in order."""
        own = Words(pa.array([text], pa.large_string()))
        best = np.full(int(own.sentence[-1]) + 1, -np.inf if self.landmarks is None else self.weights[-1])
        if self.landmarks is not None:
            _, sentence, row, values = own.hits(self.landmarks)
            np.maximum.at(best, sentence, (values @ (self.landmarks.whiten @ self.weights[:-1]) + self.weights[-1])[row])
        return (1 / (1 + np.exp(-np.clip(self.slope * best + self.offset, -700, 700)))).tolist()


def constant(toxic: np.ndarray) -> Model:
    """A model that gives every text the share of toxic labels."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    return Model(None, None, 1.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))


def train(texts: list[str], toxic: np.ndarray, most: int = 40, rounds: int = 3, seed: int = 7) -> Model:
    """Train on labelled documents held in memory.

    All sentences of a clean document are clean, and so is every place in them. Of a toxic document those
    places are toxic that the machine of the round before finds so, or else its most toxic one.
    """
    if not 0 < toxic.sum() < len(toxic):
        return constant(toxic)
    place: dict[bytes, int] = {}
    docs: list[set[bytes]] = []
    for i in range(0, len(texts), 256):
        chunk = pa.array(texts[i : i + 256], pa.large_string())
        words, own = Words(chunk), [set() for _ in chunk]
        for d, c in zip(words.document.tolist(), words.codes.tolist(), strict=True):
            own[d].add(words.words[c])
        docs += own
    chosen = choose_landmarks(docs, toxic, most)
    if not chosen:  # nothing tells the classes apart
        return constant(toxic)
    vocabulary = sorted(set().union(*docs))
    marks = Landmarks(chosen)
    parts = [(lo + hits, values) for lo in range(0, len(vocabulary), 50_000) for hits, values in [marks(vocabulary[lo : lo + 50_000])]]
    near = [vocabulary[i] for hits, _ in parts for i in hits.tolist()]
    place = {w: i for i, w in enumerate(near)}
    values = np.concatenate([v for _, v in parts])
    del parts, vocabulary
    own = [np.array(sorted(place[w] for w in d if w in place), np.int64) for d in docs]
    del docs
    clean = np.zeros(len(near), bool)
    for i in np.flatnonzero(toxic == 0):
        clean[own[i]] = True
    # a letter before an insult makes another word, one inside it does not: starts tell them apart
    starts = sorted({s[:ORDER] for s in chosen if s.startswith(START) and len(s) > ORDER} - set(chosen))
    landmarks = Landmarks(chosen + clean_landmarks(near, values, clean, len(chosen)), starts)
    hits, rows = landmarks(near, 0.0)
    strong = values.max(axis=1)
    values = np.zeros((len(near), len(landmarks.strings)), np.float32)
    values[hits] = rows
    rng = random.Random(seed)
    extra_words = [d for s in chosen for d in disguises(s.removeprefix(START).removesuffix(END), rng)]
    _, extra = landmarks([w for w in extra_words if w not in place or not clean[place[w]]])
    toxic_words = {near[i] for i in np.flatnonzero(~clean)} | set(extra_words)
    _, other = landmarks(sorted({w for s in chosen for w in lookalikes(s.removeprefix(START).removesuffix(END), rng)} - toxic_words))
    negative = np.flatnonzero(clean & (strong > 0.3))
    weights = None
    for _ in range(rounds):
        rank = strong if weights is None else values @ (landmarks.whiten @ weights[:-1]) + weights[-1]
        votes = np.zeros(len(near))
        for i in np.flatnonzero(toxic):
            able = own[i][~clean[own[i]]]
            if len(able):
                votes[able[rank[able] >= min(rank[able].max(), 0.9)]] += 1
        positive = np.flatnonzero(votes)
        x = np.vstack([values[negative], values[positive], extra, other, np.zeros((1, values.shape[1]))]) @ landmarks.whiten
        y = np.concatenate([-np.ones(len(negative)), np.ones(len(positive) + len(extra)), -np.ones(len(other)), [-1]])
        c = 100 * np.concatenate([np.full(len(negative), 3 / max(1, len(negative))), votes[positive] / max(1, votes.sum()), np.full(len(extra), 4 / max(1, len(extra))), np.full(len(other), 2 / max(1, len(other))), [1.0]])
        weights = support_vector_machine(x, y, c)
    model = Model(landmarks, weights, 1.0, 0.0)
    decide = lambda v: v @ (landmarks.whiten @ weights[:-1]) + weights[-1]
    f = decide(values)
    top = np.array([f[o].max(initial=weights[-1]) for o in own])
    model.slope, model.offset = logistic(np.concatenate([top, decide(extra)]), np.concatenate([toxic, np.ones(len(extra), np.int64)]))
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that training leaves alone; a null id is not one of them, though it is never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1000, clean_ratio: int = 3) -> Model:
    """Train on at most ``per_class`` toxic and ``clean_ratio`` times as many clean documents, none held out."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("is_toxic"))
    parts = [known.where(F.col("is_toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class * (1 if c else clean_ratio)) for c in (0, 1)]
    ids = parts[0].unionByName(parts[1])
    # one row of each chosen id, so what the driver gets is bounded by the parameters
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "is_toxic"), F.xxhash64("text")).alias("row")).select("doc_id", "row.*").orderBy("doc_id").toArrow()
    model = train(rows.column("text").to_pylist(), rows.column("is_toxic").to_numpy().astype(np.int64))
    del rows
    gc.collect()
    release()  # the driver lives on, with other stages after this one
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted (1 if the score is 0.5 or more) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized(batch, "text"):
                s = shared.value.scores(texts_of(part, "text"))
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])
                release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all columns, that the model does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized(batch, "text"):
                yield part.filter(pa.array(shared.value.scores(texts_of(part, "text")) < 0.5))
                release()

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
