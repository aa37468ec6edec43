"""Text that was read in another encoding than it was written in: finding the passages and restoring them.

Adjacent character pairs are counted over all words beyond ASCII of the corpus.  Since common damage
would count as common language, words that are plainly byte sequences are left out, and the counts are
made a second time without words that the first counts know far better in another encoding.  A pair's
score is its mutual information with rare characters' frequencies raised to a floor, so that two
strangers do not look related.  Maximum-scoring segments of improbable pairs isolate runs; inverse
mappings are tested only inside those, and one is taken if the restored run scores well above the run
as it stands and is likelier, too.  Every distinct word is tested once, wherever it stands; the texts
that hold such words are then read for quotations and restored.
"""

from __future__ import annotations

import json
import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.encodings import DOUBLE, SINGLE, WRITTEN, byte_of, to_bytes, to_text
from weftline.llm.hashing import code_points, mix
from weftline.operators.skew import MAX_HEAVY
from weftline.session import Scratch

#: Pairs are counted in this many cells; a power of two.  Bounds the model whatever the corpus.
CELLS = 1 << 21
#: Share of all characters below which a character's own frequency is not counted as rarer.
FLOOR = 1e-4
#: Sightings that every pair needs beside those expected by chance.
FEW = 4.0
#: Share of its expected count that a pair never seen is taken to have, and the range of scores.
DISCOUNT, LEAST, MOST = 0.02, -6.0, 4.0
#: A restored run may hold no character rarer than this.
RARE = 1e-7
#: A pair below this score is improbable.
LIMIT = -1.0
#: A segment of improbable pairs must sum to this to be tested.
SEGMENT = 1.5
#: Least gain in mean score of a restored run, for UTF-8 (which most bytes are not) and for others.
GAIN_UTF8, GAIN = 0.5, 2.5
#: A run restored to another encoding than UTF-8 must reach this mean score.
SOUND = 0.0
#: Encodings that pages were hardly ever written in; readings in them need this much more.
LEGACY, LEGACY_GAIN = frozenset({"mac-roman", "cp437", "cp850", "gb18030"}), 2.0
TOKEN = re.compile(r"[^ \t\r\n\f\v]*[^\x00-\x7f][^ \t\r\n\f\v]*")
RUN = re.compile(r"[^\x00-\x7f]+")
STOPS = ".!?\n。！？"
LOST = "�"
EDGE = "“”„‘’‚«»‹›–—…·¿¡ "
#: Ranks that a reading may lie behind a token's best one and still count for its mapping.
CLOSE = 2.0
#: Words whose pairs are scored together.
CHUNK = 20_000
#: Scripts whose letters do not stand beside those of others in one word.
SCRIPTS = re.compile("[\u0370-\u03ff]+|[\u0400-\u052f]+|[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\uff00-\uffef]+|[^\x00-\x7f\u0370-\u052f\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\uff00-\uffef]+")
ALL_WRITTEN = ("utf-8", *WRITTEN)
BLANKS = "\t\r\n\f\v"
#: Share of kana from which a run's Japanese reading needs no more evidence than UTF-8.
KANA = 0.2
#: A word may be left out of the second counts if another reading's pairs are e**ELSEWHERE times as
#: common; words are tested whose rarest pair has less than this share.
ELSEWHERE, RARE_PAIR = 2.5, 3e-5
#: A restored run's pairs must be e**LIKELIER times as common as the run's own.
LIKELIER = 1.0


def lowered(text: str) -> str:
    """Lower case of equal length: the one letter that becomes two is read as its plain form."""
    low = text.replace("İ", "I").lower()
    return low if len(low) == len(text) else text


def folded(text: str) -> np.ndarray:
    """Code points for pair scores: lower case, blanks as one kind, digits as one kind."""
    points = code_points(lowered(text)).copy()
    points[(points == 9) | (points == 10) | (points == 13) | (points == 0xA0)] = 32
    points[(points >= 48) & (points <= 57)] = 48
    return points


def cells_of(points: np.ndarray) -> np.ndarray:
    pairs = points[:-1].astype(np.uint64) << np.uint64(21) | points[1:].astype(np.uint64)
    return (mix(pairs) & np.uint64(CELLS - 1)).astype(np.int64)


@dataclass
class PairModel:
    """Counts of all pairs (hashed) and characters of a corpus."""

    pairs: np.ndarray
    chars: np.ndarray
    total: float

    def __post_init__(self) -> None:
        self.total = max(self.total, 1.0)
        self.share = np.maximum(self.chars / self.total, FLOOR)

    def scores(self, points: np.ndarray, cells: np.ndarray | None = None) -> np.ndarray:
        """One score for each adjacent pair: the log of its count over the count expected by chance.

        FEW more are expected than by chance alone, so that some sightings of rare characters, such as
        one damaged word in a few copies of a page, prove nothing; a pair never seen counts as DISCOUNT
        of the expectation.
        """
        single = self.share[points]
        expected = single[:-1] * single[1:] * self.total
        ratio = (self.pairs[cells_of(points) if cells is None else cells] + DISCOUNT * expected) / (expected + FEW)
        return np.clip(np.log(np.maximum(ratio, 1e-9)), LEAST, MOST)

    def ratings(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean score of each run between blanks, over its pairs that hold a character beyond ASCII, and the
        mean log of these pairs' shares of all pairs."""
        points = [folded(f" {t} ") for t in texts]
        flat = np.concatenate(points)
        cells = cells_of(flat)
        wide = flat > 127
        near = wide[:-1] | wide[1:]
        lengths = np.fromiter(map(len, points), np.int64, len(points))
        starts = np.cumsum(lengths) - lengths
        near[starts[1:] - 1] = False  # the pair between two runs belongs to neither
        counts = np.add.reduceat(np.append(near, False).astype(np.int64), starts)

        def mean(values: np.ndarray) -> np.ndarray:
            sums = np.add.reduceat(np.append(np.where(near, values, 0.0), 0.0), starts)
            return np.where(counts > 0, sums / np.maximum(counts, 1), MOST)

        return mean(self.scores(flat, cells)), mean(np.log((self.pairs[cells] + 0.5) / self.total))

    def word_sums(self, words: list[str], score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum for each word between blanks of ``score`` (of points and which pairs are beyond ASCII)."""
        points = [folded(f" {w} ") for w in words]
        flat = np.concatenate(points)
        wide = flat > 127
        near = wide[:-1] | wide[1:]
        lengths = np.fromiter(map(len, points), np.int64, len(points))
        starts = np.cumsum(lengths) - lengths
        near[starts[1:] - 1] = False
        return np.add.reduceat(np.append(np.where(near, score(flat, near), 0.0), 0.0), starts)

    def known(self) -> frozenset[str]:
        """Characters beyond ASCII that the corpus uses."""
        return frozenset(map(chr, np.flatnonzero(self.chars >= max(2.0, self.total * RARE)) ))


def utf8_inside(run: str) -> str | None:
    """The run as UTF-8 if it was read in a single-byte encoding, without asking any model."""
    if len(run) < 2:
        return None
    first, second = ord(run[0]), ord(run[1])
    for read_as in SINGLE:
        table = byte_of(read_as)
        # most runs cannot begin a UTF-8 sequence: two look-ups tell
        if 0xC2 <= table.get(first, 0) <= 0xF4 and 0x80 <= table.get(second, 0) <= 0xBF:
            data = to_bytes(run, read_as)
            if data and (text := to_text(data, "utf-8", loose=True)) and text != run:
                return text
    return None


def kana_share(text: str) -> float:
    """Share of hiragana and katakana; the bytes of other scripts hardly ever read as these."""
    return sum("\u3041" <= c <= "\u30fe" for c in text) / len(text) if text else 0.0


def _kana_inside(token: str) -> bool:
    first, last = ord(token[0]), ord(token[-1])
    for read_as in SINGLE:
        table = byte_of(read_as)
        data = to_bytes(token, read_as) if first in table and last in table else None
        if data:
            for written_as in ("euc_jp", "shift_jis"):
                text = to_text(data, written_as)
                if text and kana_share(text) >= KANA:
                    return True
    return False


def _plain(token: str) -> bool:
    """Whether a token is evidently made of other bytes or holds lost characters; such do not count as corpus."""
    if LOST in token or any("\x7f" <= c <= "\x9f" for c in token):
        return True
    for m in RUN.finditer(token):
        run = m.group()
        if len(run) > 1 and (utf8_inside(run) or utf8_inside(run.strip(EDGE))):
            return True
        # two kanji beside kana are Japanese, whatever their bytes
        data = to_bytes(run, "gb18030") if run[0] > "\u2e7f" and (len(run) > 1 or len(run) < len(token)) else None
        if data and len(data) >= 4 and to_text(data, "utf-8"):
            return True
    return len(token) >= 6 and _kana_inside(token)


def wide_words(text: str) -> list[str]:
    """Words beyond ASCII, cut at ASCII blanks only."""
    for blank in BLANKS:
        text = text.replace(blank, " ")
    return [w for w in text.split(" ") if not w.isascii()]


WORDS = "word string, n bigint"
STATS = "kind int, cell bigint, n bigint"


def _doc_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc_id, word, n): the words beyond ASCII of each text."""
    for batch in batches:
        docs, words, counts = [], [], []
        for doc, text in zip(batch.doc_id, batch.text, strict=True):
            if not text.isascii():
                inside: dict[str, int] = {}
                for w in wide_words(text):
                    inside[w] = inside.get(w, 0) + 1
                docs += [doc] * len(inside)
                words += inside.keys()
                counts += inside.values()
        yield pd.DataFrame({"doc_id": np.array(docs, np.int64), "word": words, "n": np.array(counts, np.int64)})


def _count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sparse pair counts (kind 0) and character counts (kind 1) of a partition of words."""
    pairs, chars = np.zeros(CELLS, np.int64), np.zeros(0x110000, np.int64)
    for batch in batches:
        if not len(batch):
            continue
        points = [folded(f" {w} ") for w in batch.word]
        weights = np.repeat(batch.n.to_numpy(), [len(p) for p in points])
        flat = np.concatenate(points)
        np.add.at(chars, flat, weights)
        wide = flat > 127
        near = np.flatnonzero(wide[:-1] | wide[1:])
        np.add.at(pairs, cells_of(flat)[near], weights[near])
    for kind, table in ((0, pairs), (1, chars)):
        at = np.flatnonzero(table)
        yield pd.DataFrame({"kind": np.full(len(at), kind, np.int32), "cell": at, "n": table[at]})


def _model(words: DataFrame) -> PairModel:
    """At most CELLS + 0x110000 sums come to the driver, whatever the corpus."""
    sums = words.mapInPandas(_count_pairs, STATS).groupBy("kind", "cell").agg(F.sum("n").alias("n")).toPandas()
    pairs, chars = np.zeros(CELLS, np.float32), np.zeros(0x110000, np.float32)
    for kind, table in ((0, pairs), (1, chars)):
        part = sums[sums.kind == kind]
        table[part.cell.to_numpy(np.int64)] = part.n.to_numpy(np.float32)
    return PairModel(pairs, chars, float(chars.sum()))


def _without_plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        kept = [(w, n) for w, n in zip(batch.word, batch.n, strict=True) if not _plain(w)]
        if kept:
            yield pd.DataFrame(kept, columns=["word", "n"])


def fit_pairs(words: DataFrame) -> PairModel:
    """Pair statistics of all words (word, n), counted twice: the second time without words that another
    reading turns into far likelier ones which the corpus holds, too."""
    spark = words.sparkSession
    words = Scratch(spark, "pairs").cut(words.mapInPandas(_without_plain, WORDS), "words")
    first = spark.sparkContext.broadcast(_model(words))

    def readings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(first.value)
        for batch in batches:
            yield pd.DataFrame(restorer.elsewhere(batch.word.tolist()) if len(batch) else [], columns=["old", "word"])

    parts = 4 * spark.sparkContext.defaultParallelism
    other = words.repartition(parts, "word").mapInPandas(readings, "old string, word string")
    damaged = other.join(words.select("word"), "word", "left_semi").select(F.col("old").alias("word")).distinct()
    return _model(words.join(damaged, "word", "left_anti"))


def segments(gains: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Maximum-scoring segments [a, b) of a sequence that reach ``least``, left to right, disjoint."""
    out, start, total, best, end = [], 0, 0.0, 0.0, 0
    for i, g in enumerate(gains.tolist()):
        if total <= 0:
            if best >= least:
                out.append((start, end))
            start, total, best, end = i, 0.0, 0.0, i
        total += g
        if total > best:
            best, end = total, i + 1
        elif best >= least and total < best - least:
            out.append((start, end))
            start, total, best, end = i + 1, 0.0, 0.0, i + 1
    if best >= least:
        out.append((start, end))
    return out


@dataclass(frozen=True)
class Candidate:
    """A run [lo, hi) of a token, its restored form, and the mapping that gives it; a lost run restores to itself."""

    rank: float
    lo: int
    hi: int
    text: str
    how: tuple[str, ...]


class Restorer:
    """Tests inverse mappings inside the improbable runs of tokens."""

    def __init__(self, model: PairModel):
        self.model = model
        self.known = model.known() | frozenset(map(chr, range(128)))

    def tokens(self, tokens: list[str]) -> Iterator[tuple[str, list[Candidate]]]:
        """Tokens with their candidates; most show too few improbable pairs for any segment and are passed over together."""
        for start in range(0, len(tokens), CHUNK):
            part = tokens[start : start + CHUNK]
            most = self.model.word_sums(part, lambda points, near: np.maximum(LIMIT - self.model.scores(points), 0.0))
            for token, reach in zip(part, most, strict=True):
                if (reach >= SEGMENT or LOST in token) and (found := self.token(token)):
                    yield token, found

    def token(self, token: str) -> list[Candidate]:
        """Restored forms of all improbable runs, best first."""
        points = folded(f" {token} ")
        scores = self.model.scores(points)
        wide = points > 127
        gains = np.where(wide[:-1] | wide[1:], LIMIT - scores, -0.5)
        # pair i joins token characters i - 1 and i
        runs = [(max(0, a - 1), min(len(token), b)) for a, b in segments(gains, SEGMENT)]
        found: dict[tuple, Candidate] = {}
        for spans in self._spans(token, runs):
            for lo, hi in spans:
                if lo < hi and not token[lo:hi].isascii():
                    found |= {(c.lo, c.hi, c.text): c for c in self._inverse(token, lo, hi)}
            if found:
                break
        if LOST in token:
            found[0, len(token), token] = Candidate(9.0, 0, len(token), token, ())
        return sorted(found.values(), key=lambda c: -c.rank)

    def _spans(self, token: str, runs: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
        """What to test in a token's improbable runs: the characters beyond ASCII around each, with and without
        outer marks and following bytes; all runs together; and if nothing comes of that, parts of one
        script and the bare runs, which sound text of another script may surround."""
        outer: list[tuple[int, int]] = []
        wide = [m.span() for m in RUN.finditer(token)]
        starts = [lo for lo, _ in wide]
        for lo, hi in runs:
            # from the first to the last stretch beyond ASCII that the run holds or borders on
            first, last = max(0, bisect_right(starts, lo) - 1), bisect_right(starts, hi) - 1
            first += wide[first][1] < lo
            if last < first:
                continue
            tail, lo, hi = hi, wide[first][0], wide[last][1]
            left, right = 0, 0
            while lo + left < hi and token[lo + left] in EDGE:
                left += 1
            while hi - right > lo and token[hi - right - 1] in EDGE:
                right += 1
            outer += [(lo, hi), (lo + left, hi), (lo, hi - right), (lo + left, hi - right), (lo, min(len(token), max(tail, hi + 1)))]
        if outer:
            outer.append((min(lo for lo, _ in outer), max(hi for _, hi in outer)))
        yield list(dict.fromkeys(outer))
        parts = [m.span() for m in SCRIPTS.finditer(token)]
        starts = [lo for lo, _ in parts]
        inner: list[tuple[int, int]] = []
        for lo, hi in runs:
            inner += parts[max(0, bisect_right(starts, lo) - 1) : bisect_left(starts, hi)]
            inner += [(lo, hi), (lo + 1, hi), (lo, hi - 1), (lo + 1, hi - 1)]
        known = set(outer)
        yield [s for s in dict.fromkeys(inner) if s not in known]

    def _forms(self, run: str) -> dict[str, tuple[str, ...]]:
        """Other readings of a run that use known characters only, and the mappings that give them."""
        forms: dict[str, tuple[str, ...]] = {}
        first, last = ord(run[0]), ord(run[-1])
        east = max(run) > "\u2e7f"  # marks alone do not make a double-byte text
        for read_as in (*SINGLE, *DOUBLE):
            if read_as in DOUBLE and east or first in byte_of(read_as) and last in byte_of(read_as):
                data = to_bytes(run, read_as)
            else:
                data = None
            if data is None or data.isascii():
                continue
            for written_as in ALL_WRITTEN:
                if written_as == read_as:
                    continue
                utf8 = written_as == "utf-8"
                text, how = to_text(data, written_as, loose=utf8), (read_as, written_as)
                while utf8 and text and (deeper := utf8_inside(text)):
                    text, how = deeper, (*how, "again")
                if text and text != run and self.known.issuperset(lowered(text)) and (
                    text not in forms or utf8 and forms[text][1] != "utf-8"
                ):
                    forms[text] = how
        return forms

    def _inverse(self, token: str, lo: int, hi: int) -> list[Candidate]:
        """Forms of a run that score well above it, between the characters around it."""
        run, head, rear = token[lo:hi], token[max(0, lo - 1) : lo], token[hi : hi + 1]
        forms = self._forms(run)
        if not forms:
            return []
        texts = [head + run + rear, *(head + t + rear for t in forms)]
        scores, likely = self.model.ratings(texts)
        out = []
        for i, (text, how) in enumerate(forms.items(), 1):
            gain, more = scores[i] - scores[0], likely[i] - likely[0]
            need = GAIN + LEGACY_GAIN if how[1] in LEGACY else GAIN
            sure = how[1] == "utf-8" or how[1] in ("euc_jp", "shift_jis") and kana_share(text) >= KANA
            if gain >= (GAIN_UTF8 if sure else need) and (sure or scores[i] >= SOUND and more >= LIKELIER):
                # bytes that are UTF-8 are hardly anything else
                out.append(Candidate(float(gain) + (6.0 if how[1] == "utf-8" else 2.0) * sure, lo, hi, text, how))
        return out

    def elsewhere(self, words: list[str]) -> list[tuple[str, str]]:
        """(word, other reading) wherever the reading's pairs are far more common than the word's own."""
        model, out = self.model, []
        rare = model.word_sums(words, lambda points, near: model.pairs[cells_of(points)] < RARE_PAIR * model.total)
        for i in np.flatnonzero(rare):
            if kana_share(words[i]) < KANA and (forms := self._forms(words[i])):
                _, likely = model.ratings([words[i], *forms])
                out += [(words[i], f) for f, gain in zip(forms, likely[1:] - likely[0], strict=True) if gain >= ELSEWHERE]
        return out


def _sentence(text: str, at: int) -> tuple[int, int]:
    lo = max(text.rfind(c, 0, at) for c in STOPS) + 1
    return lo, min((e for c in STOPS if (e := text.find(c, at)) >= 0), default=len(text))


def tells_of_damage(sentence: str, tokens: list[tuple[str, list[Candidate]]]) -> bool:
    """Whether a restored form of each token also stands in the sentence as a word of its own.

    The rest of such a sentence is plain: one that holds other words beyond ASCII merely repeats itself.
    """
    damaged = dict(tokens)
    plain = rest = TOKEN.sub(lambda m: " " if m.group() in damaged else m.group(), sentence)
    for token, found in damaged.items():
        runs = [r for m in RUN.finditer(token) for r in (m.group(), m.group().strip(EDGE))]
        forms = {f.strip(EDGE) for c in found if c.text != token[c.lo : c.hi] for f in (c.text, token[: c.lo] + c.text + token[c.hi :])}
        forms |= {f for r in runs if (f := utf8_inside(r))}
        forms = {f for f in forms if any(c > "\x7f" and c.isalpha() for c in f)}
        standing = [f for f in forms if f in rest and re.search(rf"(?<!\w){re.escape(f)}(?!\w)", rest)]
        if not standing:
            return False
        for f in standing:
            plain = re.sub(rf"(?<!\w){re.escape(f)}(?!\w)", " ", plain)
    return not any(c > "\x7f" and c.isalpha() for c in plain)


def rebuilt(token: str, found: list[Candidate], votes: dict[tuple[str, ...], float], look: Callable[[str], list[Candidate]]) -> str:
    """The token with all its runs restored, until nothing changes: those first that most votes are for, then
    those that gain most, over all their characters."""
    seen = {token}

    def order(c: Candidate) -> tuple[float, float]:
        return -votes.get(c.how[:2], 0.0), -c.rank * sum(x > "\x7f" for x in token[c.lo : c.hi])

    while found:
        taken: list[Candidate] = []
        for c in sorted(found, key=order):
            if c.text != token[c.lo : c.hi] and all(c.hi <= t.lo or c.lo >= t.hi for t in taken):
                taken.append(c)
        for c in sorted(taken, key=lambda c: -c.lo):
            token = token[: c.lo] + c.text + token[c.hi :]
        if token in seen:
            break
        seen.add(token)
        found = look(token)
    return token


def restore(text: str, restorer: Restorer, known: dict[str, list[Candidate]]) -> tuple[int, str]:
    """(number of garbled tokens, text with what could be restored); ``known`` holds the candidates of its tokens.

    A text's tokens vote for the mapping, so that a token with several readings follows the others.
    A sentence that shows damage beside the right form quotes it and is left alone.
    """
    sentences: dict[tuple[int, int], list] = {}
    for m in TOKEN.finditer(text):
        if found := known.get(m.group()):
            sentences.setdefault(_sentence(text, m.start()), []).append((m, found))
    tokens, votes = [], {}
    for (lo, hi), inside in sentences.items():
        if tells_of_damage(text[lo:hi], [(m.group(), f) for m, f in inside]):
            continue
        tokens += inside
        for _, found in inside:
            best: dict[tuple[str, ...], float] = {}
            for c in found:
                if c.how:
                    best[c.how[:2]] = max(best.get(c.how[:2], 0.0), c.rank)
            for how, rank in best.items():  # readings far behind the best one have no say
                votes[how] = votes.get(how, 0.0) + max(0.0, rank - max(best.values()) + CLOSE)
    count = len(tokens)
    if votes:
        tokens = sorted([*tokens, *_also(text, restorer, tokens, max(votes, key=votes.get))], key=lambda x: x[0].start())
    out, last, made = [], 0, {}
    for m, found in tokens:
        token = m.group()
        if token not in made:
            made[token] = rebuilt(token, found, votes, restorer.token)
        out += [text[last : m.start()], made[token]]
        last = m.end()
    return count, "".join([*out, text[last:]])


def _also(text: str, restorer: Restorer, known: list, how: tuple[str, ...]) -> list:
    """Tokens too unsure by themselves that the mapping of most damage in the text makes likelier."""
    done, out = {m.start() for m, _ in known}, []
    if len(how) < 2 or len(known) < 3:
        return out
    for m in TOKEN.finditer(text):
        token = m.group()
        data = None if m.start() in done else to_bytes(token, how[0])
        good = data and to_text(data, how[1])
        if good and good != token and restorer.known.issuperset(lowered(good)):
            now, was = restorer.model.ratings([good, token])[0]
            if now > was + GAIN_UTF8:
                out.append((m, [Candidate(0.0, 0, len(token), good, how)]))
    return out


_RESTORERS: dict[str, Restorer] = {}


def restorer_of(name: str, model) -> Restorer:
    """The restorer of one run, kept by the worker process from task to task."""
    if name not in _RESTORERS:
        _RESTORERS.clear()
        _RESTORERS[name] = Restorer(model.value)
    return _RESTORERS[name]


def _packed(found: list[Candidate]) -> str:
    return json.dumps([[c.rank, c.lo, c.hi, c.text, *c.how] for c in found])


def _unpacked(text: str) -> list[Candidate]:
    return [Candidate(rank, lo, hi, form, tuple(how)) for rank, lo, hi, form, *how in json.loads(text)]


def find_garbled(texts: DataFrame, model: PairModel | None = None) -> DataFrame:
    """(doc_id, n_garbled, restored) of the texts that hold a garbled passage.

    Null and empty texts hold none.  ``restored`` keeps what cannot be restored as it stands.
    Without a model the pair statistics of ``texts`` are used.
    """
    spark = texts.sparkSession
    scratch = Scratch(spark, "garbled")
    texts = texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    inside = scratch.cut(texts.mapInPandas(_doc_words, "doc_id bigint, word string, n bigint"), "inside")
    words = scratch.cut(inside.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("docs")), "words")
    parts = 4 * spark.sparkContext.defaultParallelism  # words are few but dear to test
    model = model or fit_pairs(words.select("word", "n"))
    shared, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = dict(restorer_of(name, shared).tokens(batch.word.tolist())) if len(batch) else {}
            part = batch[batch.word.isin(found)]
            yield pd.DataFrame({"word": part.word, "docs": part.docs, "found": [_packed(found[w]) for w in part.word]})

    tested = words.select("word", "docs").repartition(parts, "word").mapInPandas(test, "word string, docs bigint, found string")
    damaged = scratch.cut(tested.withColumn("h", F.xxhash64("word")), "damaged")
    # words of very many texts are few and go to these by broadcast; only hashes of the others move, and
    # a text that is sent another word of equal hash does not hold that
    held = inside.select("doc_id", F.xxhash64("word").alias("h"))
    hot = F.col("docs") * MAX_HEAVY > F.lit(inside.count())
    hits = held.join(F.broadcast(damaged.where(hot)), "h").unionByName(held.join(damaged.where(~hot), "h"))
    hits = hits.groupBy("doc_id").agg(F.collect_list(F.struct("word", "found")).alias("hits"))
    hits = scratch.cut(hits, "hits")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, found in zip(batch.doc_id, batch.text, batch.hits, strict=True):
                known = {h["word"]: _unpacked(h["found"]) for h in found}
                count, good = restore(text, restorer_of(name, shared), known)
                if count:
                    rows.append((doc, count, good))
            yield pd.DataFrame(rows, columns=["doc_id", "n_garbled", "restored"])

    touched = scratch.cut(texts.join(hits.select("doc_id"), "doc_id", "left_semi"), "touched")
    return touched.join(hits, "doc_id").mapInPandas(run, "doc_id bigint, n_garbled int, restored string")
