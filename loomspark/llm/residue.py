"""Template residue and error-page text, by character n-gram models.

Models are fitted on seed texts: filler, pseudo-Latin filler, error messages and dumps, and notices that scripts are required; another
one on sentences of people who mention such things (``phrases.py``: public standard messages, and phrases made by rule). Natural prose is
the n-gram counts over all documents, without the windows that would be residue if no n-gram of the seed texts stood in prose; a notice
is one of these however often it occurs, so its copies don't make it prose. An n-gram is worth its log-likelihood ratio against prose;
one that a model hasn't seen falls back on its parts of length BACK.

A text is screened by the largest evidence of any stretch of it, for a batch of texts at once. In those that have it, the windows are
the text's units (sentences and lines) and every stretch of WINDOW characters; a window is residue if its mean ratio reaches THRESHOLD
for a residue model and is above that of the mention model. Template fields are found by delimiters that mirror each other. Which names
stand for fields is learned from the corpus: those between delimiters of two and more signs, {{name}} and the like. Between single signs
a name counts if it is one of these, a standard field name, or several words joined by signs. A document's coverage is the part of its
characters that lies in residue windows and fields.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.phrases import FIELD_NAMES, seed_texts
from loomspark.session import Workspace

#: Length of an n-gram and of those it falls back on; characters of a window; mean log-likelihood ratio from which a window is residue.
N, BACK, WINDOW, THRESHOLD = 5, 3, 60, 1.0
#: A unit needs this much evidence in all, and, if it has fewer than SHORT n-grams, that mean (and mostly n-grams of the model's own).
EVIDENCE, SHORT, SHORT_MEAN = 15.0, 20, 2.0
#: Largest evidence of one n-gram; what falling back costs, and the least and most that it may say.
MOST, BACK_COST, BACK_LEAST, BACK_MOST = 6.0, 0.5, -4.0, 1.5
#: Part of a unit's n-grams, or of a window's, that must be seed n-grams for it not to count as prose, and of a short unit's that must be the model's own.
SEEDED, OWN = 0.75, 0.65
#: Natural prose starts as PRIOR n-grams of which each kind is a part RARE, so a small corpus is judged like a large one.
PRIOR, RARE = 1e5, 1e-6
#: Places of the table of short n-grams.
PLACES = 1 << 16

CLASSES = ("filler", "latin", "error", "script", "mention")
_SIGNS = r"\[\](){}<>%$#@_~^|*="
#: An identifier, or a few words, between signs that mirror each other.
_PAIRED = regex.compile(rf"(?<![{_SIGNS}\w])(&lt;|[{_SIGNS}]{{1,3}})\s?([\p{{L}}][\w.\- ]{{0,38}}?)\s?(&gt;|\)s|[{_SIGNS}]{{1,3}})(?![{_SIGNS}\w])")
#: What asks to be filled in, in brackets; slots without a name; statements of template languages.
_ASKED = regex.compile(r"[\[<{(]\s?(?:(?:insert|enter|add|type|your|todo|placeholder|tbd|hier|bitte|ihr|ihre|insérez|saisissez|votre|inserte|escriba|su)\s[^\[\]<>{}()]{1,60}|[^\[\]<>{}()]{1,60}\s(?:here|einfügen|eingeben|ici|aquí))\s?[\]>})]", regex.I)
_SLOT = regex.compile(r"(?<![\w%])%[sd](?!\w)|\{\d\}|\{%[^{}%]{1,300}%\}|<%[^<>%]{1,300}%>")
# Words of people who talk about templates.
_META = regex.compile(r"template|placeholder|variable|mail.?merge|syntax|vorlage|platzhalter|serienbrief|publipostage|plantilla|segnaposto", regex.I)
_MIRROR = str.maketrans("[({<", "])}>")
_SEPARATORS = regex.compile(r"[\s_.\-]+")
_UNIT = regex.compile(r"(?<=[.!?…])[\s\"']+|\s*\n+\s*|\s+\.\.\.\s+|\s+[-–|]\s+(?=\S)")
#: What a short unit is judged without.
_ENDS = " \t\n.!?…\"'*,;:-"
_UNSEEN = regex.compile(r"\p{Cf}+")
_DIGITS = regex.compile(r"\d+")
_SPACE = regex.compile(r"\s+")
_LINES = regex.compile(r"[^\S\n]*\n\s*|[^\S\n]+")


def _plain(text: str) -> str:
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
    return _DIGITS.sub("0", text.lower())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(f" {_SPACE.sub(' ', _plain(text))} ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)


def _hashes(c: np.ndarray, n: int) -> np.ndarray:
    """A number for each n-gram of a text, in order."""
    if len(c) < n:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(len(c) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ c[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


class Models:
    """The n-grams of the seed texts, and for each class what each is worth."""

    def __init__(self, seeds: dict[str, list[str]] | None = None):
        codes = {c: [_codes(t) for t in texts] for c, texts in (seeds or seed_texts()).items()}
        long = {c: np.unique(np.concatenate([_hashes(x, N) for x in codes[c]])) for c in CLASSES}
        self.grams = np.unique(np.concatenate(list(long.values())))
        # each distinct n-gram of a class once: a class is a set of phrases, not a sample of their frequencies
        self.counts = np.array([np.isin(self.grams, long[c]) for c in CLASSES], dtype=float)
        self.short = np.zeros((len(CLASSES), PLACES))
        for k, c in enumerate(CLASSES):
            short = np.unique(np.concatenate([_hashes(x, BACK) for x in codes[c]]))
            np.add.at(self.short[k], (short & np.uint64(PLACES - 1)).astype(np.int64), 1)
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.grams & np.uint64(len(self.maybe) - 1)).astype(np.int64)] = True
        self.seeds = np.r_[(self.counts[:-1] > 0).any(axis=0), False]
        self.fit(np.zeros(len(self.grams)), np.zeros(PLACES), 0)

    def places(self, grams: np.ndarray) -> np.ndarray:
        """The n-grams' numbers, one past the last for those of no class."""
        out = np.full(len(grams), len(self.grams))
        some = np.flatnonzero(self.maybe[(grams & np.uint64(len(self.maybe) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.grams, grams[some]), len(self.grams) - 1)
        out[some] = np.where(self.grams[at] == grams[some], at, len(self.grams))
        return out

    def fit(self, natural: np.ndarray, short: np.ndarray, total: int) -> None:
        """natural, short: how often each n-gram, and each place of short ones, stands in natural prose of ``total`` n-grams. With none, every seed n-gram is worth MOST and any other nothing."""
        size = self.counts.sum(axis=1, keepdims=True)
        size[-1] = size.max()  # the few mention seeds don't win by their number
        own = self.counts / np.maximum(1, size)
        prose = (natural + PRIOR * RARE) / (total + PRIOR)
        with np.errstate(divide="ignore"):
            ratio = np.clip(np.log(own / prose), -MOST, MOST) if total else np.full_like(own, MOST)
            part = (self.short + 0.2) / (self.short.sum(axis=1, keepdims=True) + 0.2 * PLACES)
            back = np.clip(np.log(part / ((short + 0.2) / (total + 0.2 * PLACES))) - BACK_COST, BACK_LEAST, BACK_MOST) if total else np.full_like(part, BACK_LEAST)
        self.worth = np.c_[np.where(self.counts > 0, ratio, -np.inf), np.full(len(CLASSES), -np.inf)].astype(np.float32)
        self.back = back.astype(np.float32)
        # of the residue models the best, to screen with
        self.best, self.best_back = self.worth[:-1].max(axis=0), self.back[:-1].max(axis=0)

    def _worth(self, codes: np.ndarray) -> np.ndarray:
        """What each n-gram of a text is worth for each class."""
        if len(codes) < N:
            return np.zeros((len(CLASSES), 0), dtype=np.float32)
        at = self.places(_hashes(codes, N))
        worth = self.worth[:, at]
        return np.where(np.isneginf(worth), self._fallen(codes, self.back, len(at)), worth)

    @staticmethod
    def _fallen(codes: np.ndarray, back: np.ndarray, n: int) -> np.ndarray:
        """The mean of the parts that an n-gram falls back on."""
        part = back[..., (_hashes(codes, BACK) & np.uint64(PLACES - 1)).astype(np.int64)]
        return sum(part[..., k : k + n] for k in range(N - BACK + 1)) / (N - BACK + 1)

    def screened(self, texts: list[str]) -> np.ndarray:
        """Which texts have a stretch with the evidence that a window needs."""
        codes = [_codes(t) for t in texts]
        joined = np.concatenate(codes)
        ends = np.cumsum([len(c) for c in codes])
        if len(joined) < N:
            return np.zeros(len(texts), dtype=bool)
        at = self.places(_hashes(joined, N))
        worth = self.best[at].astype(float)
        none = np.isneginf(worth)
        worth[none] = self._fallen(joined, self.best_back, len(at))[none]
        # an n-gram over the border of two texts ends every stretch
        for k in range(1, N):
            worth[np.minimum(ends[:-1] - k, len(worth) - 1)] = -1e5
        sums = np.r_[0.0, np.cumsum(worth)]
        rise = np.maximum(sums[1:] - np.minimum.accumulate(sums)[:-1], 0)
        starts = np.minimum(np.r_[0, ends[:-1]], len(rise) - 1)
        return np.maximum.reduceat(rise, starts) >= EVIDENCE

    def judge(self, text: str, full: bool = True) -> tuple[int, set[str], list[tuple[str, int]]]:
        """Characters of a text that lie in residue windows, the kinds of residue, and names in delimiters that may be fields, with their lengths. full: whether to look at more than fields."""
        covered, kinds, unsure = np.zeros(len(text), dtype=bool), set(), []
        for a, b, name in fields(text):
            before, after = _UNIT.split(text[max(0, a - 200) : a])[-1], _UNIT.split(text[b : b + 200])[0]
            if _META.search(before) or _META.search(after) or self._worth(_codes(f"{before}{text[a:b]}{after}"))[-1].mean() >= THRESHOLD:
                continue
            if name is None:
                covered[a:b] = True
                kinds.add("field")
            else:
                unsure.append((name, b - a))
        units, start = [], 0
        for m in [*_UNIT.finditer(text), None] if full else []:
            end = m.start() if m else len(text)
            unit = text[start:end]
            if len(unit) < 2 * SHORT:
                start += len(unit) - len(unit.lstrip(_ENDS))
                unit = unit.strip(_ENDS)
            if unit.strip():
                units.append((start, unit))
            start = m.end() if m else end
        some = self.screened([u for _, u in units]) if units else []
        for start, unit in (u for u, able in zip(units, some) if able):
            for a, b, kind in self._windows(unit):
                covered[start + a : start + b] = True
                kinds.add("filler" if kind == "latin" else kind)
        return int(covered.sum()), kinds, unsure

    def prose(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the n-grams, and the places of the short ones, that count as natural prose while nothing is fitted: of all but the
        stretches of WINDOW and the units whose seed n-grams would make them residue."""
        joined = "\0".join(_LINES.sub(lambda m: "\n" if "\n" in m[0] else " ", _plain(t.replace("\0", " "))) for t in texts)
        codes = np.frombuffer(f"\0{joined}\0".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        ends = np.isin(codes, np.array([ord(c) for c in "\0\n.!?…|"], dtype=np.uint64))
        codes[codes == 10] = 32
        if len(codes) < N:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = self.places(_hashes(codes, N))
        seed = self.seeds[at].astype(np.int64)
        unit = np.cumsum(ends)[: len(at)]
        first = np.flatnonzero(np.r_[True, np.diff(unit) > 0])
        size = np.diff(np.r_[first, len(at)])
        left_out = np.repeat(np.add.reduceat(seed, first) >= SEEDED * np.maximum(size - N + 1, 1), size)
        if len(at) > WINDOW:
            sums = np.r_[0, np.cumsum(seed)]
            hit = np.flatnonzero(sums[WINDOW:] - sums[:-WINDOW] >= SEEDED * WINDOW)
            marks = np.zeros(len(at) + 1, dtype=np.int64)
            np.add.at(marks, hit, 1)
            np.add.at(marks, np.minimum(hit + WINDOW, len(at)), -1)
            left_out |= np.cumsum(marks[:-1]) > 0
        keep = ~left_out & (codes[: len(at)] != 0)
        return at[keep], (_hashes(codes, BACK)[: len(at)][keep] & np.uint64(PLACES - 1)).astype(np.int64)

    def _windows(self, unit: str) -> Iterator[tuple[int, int, str]]:
        worth = self._worth(_codes(unit))
        n = worth.shape[1]
        if not n:
            return
        mean = worth.mean(axis=1)
        best = int(mean[:-1].argmax())
        if mean[best] >= (SHORT_MEAN if n < SHORT else THRESHOLD):
            seeded = n >= SHORT or np.isfinite(self.worth[best, self.places(_hashes(_codes(unit), N))]).mean() >= OWN
            if seeded and mean[best] > mean[-1] and worth[best].sum() >= EVIDENCE:
                yield 0, len(unit), CLASSES[best]
            return
        if mean[-1] >= THRESHOLD or n <= WINDOW:
            return
        sums = np.cumsum(np.c_[np.zeros(len(CLASSES)), worth], axis=1)
        run = (sums[:, WINDOW:] - sums[:, :-WINDOW]) / WINDOW
        hit = np.flatnonzero((run[:-1].max(axis=0) >= THRESHOLD) & (run[-1] < run[:-1].max(axis=0)))
        if len(hit):
            scale = len(unit) / n  # spaces and digits may have been joined
            yield int(hit[0] * scale), min(len(unit), int((hit[-1] + WINDOW) * scale) + 1), CLASSES[int(run[:-1, hit].max(axis=1).argmax())]


def _key(name: str) -> str:
    return _SEPARATORS.sub("", name.lower())


def fields(text: str) -> Iterator[tuple[int, int, str | None]]:
    """Places of template fields; with a name where it depends on the name whether it is one."""
    if not any(c in text for c in "{[<%#$@_&"):
        return
    for pattern in (_ASKED, _SLOT):
        for m in pattern.finditer(text):
            yield *m.span(), None
    for m in _PAIRED.finditer(text):
        opening, name, closing = m.groups()
        if closing == ("&gt;" if opening == "&lt;" else opening[::-1].translate(_MIRROR)) or (opening, closing) in (("%(", ")s"), ("${", "}"), ("#{", "}"), ("$(", ")")):
            sure = (len(opening) > 1 and opening not in ("&lt;", "**", "***", "__", "~~", "((", "==")) and " " not in name
            joined = any(c in name for c in "_.") and " " not in name and not name.endswith(".")
            yield *m.span(), None if sure or joined or _key(name) in FIELD_NAMES and opening not in ("(", "*", "|") else name


def _sure_names(text: str) -> Iterator[str]:
    for m in _PAIRED.finditer(text) if any(c in text for c in "{[<%#$@") else ():
        if len(m[1]) > 1 and m[1][0] in "{[<%#$@" and " " not in m[2]:
            yield _key(m[2])


def _count(models: Models):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen, short, names = 0, np.zeros(len(models.grams) + 1, dtype=np.int64), np.zeros(PLACES, dtype=np.int64), set()
        for batch in batches:
            for k in range(0, len(batch), 200):
                texts = batch["text"].iloc[k : k + 200].tolist()
                at, place = models.prose(texts)
                total += len(at)
                seen += np.bincount(at, minlength=len(seen))
                short += np.bincount(place, minlength=PLACES)
                names.update(n for t in texts for n in _sure_names(t))
        some, parts = np.flatnonzero(seen[:-1]), np.flatnonzero(short)
        yield pd.DataFrame({"kind": "gram", "at": np.r_[some, -1], "n": np.r_[seen[some], total], "name": None})
        yield pd.DataFrame({"kind": "part", "at": parts, "n": short[parts], "name": None})
        if names:
            yield pd.DataFrame({"kind": "name", "at": 0, "n": 1, "name": sorted(names)})

    return count


def fit_models(documents: DataFrame, text: str = "text", models: Models | None = None) -> tuple[Models, DataFrame]:
    """The models, with natural prose counted over all texts but their residue windows, and the field names (name) learned from them. One
    row for each n-gram of the seed texts and each place of the short ones comes to the driver, whatever the number of texts; the names don't."""
    models, ws = models or Models(), Workspace(documents.sparkSession)
    texts = documents.select(F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    counted = texts.mapInPandas(_count(models), "kind string, at int, n long, name string").groupBy("kind", "at", "name").agg(F.sum("n").alias("n"))
    counted = ws.keep(counted, "counted")
    natural, short, total = np.zeros(len(models.grams)), np.zeros(PLACES), 0
    for kind, at, n in counted.where("kind <> 'name'").select("kind", "at", "n").toLocalIterator():
        if at < 0:
            total = n
        else:
            (natural if kind == "gram" else short)[at] = n
    models.fit(natural, short, total)
    return models, counted.where("kind = 'name'").select("name").distinct()


def _judged(models: Models):
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 200):
                part, out = batch.iloc[k : k + 200], []
                texts = part["text"].tolist()
                for d, text, full in zip(part["doc"].tolist(), texts, models.screened(texts)):
                    n, kinds, unsure = models.judge(text, full)
                    if n or unsure:
                        out.append((d, n, len(text), sorted(kinds), [_key(u) for u, _ in unsure], [c for _, c in unsure]))
                yield pd.DataFrame(out, columns=["doc", "n", "length", "kinds", "names", "lengths"])

    return judge


def residue(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", models: Models | None = None) -> DataFrame:
    """(doc_id, coverage, kinds): the documents that hold residue, the part of their characters that is, and its kinds (filler, error,
    script, field). Null, empty and blank texts and null ids are in no row; a document that occurs several times is in one, with its
    largest coverage. Other columns are ignored. ``models``: seed models of one's own, fitted here."""
    ws = Workspace(documents.sparkSession)
    models, names = fit_models(documents, text, models)
    docs = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    found = ws.keep(docs.mapInPandas(_judged(models), "doc long, n long, length long, kinds array<string>, names array<string>, lengths array<long>"), "judged")
    sure = found.where("n > 0").select("doc", "n", "length", F.explode("kinds").alias("kind"))
    unsure = found.select("doc", "length", F.explode(F.arrays_zip("names", "lengths")).alias("u")).select("doc", "length", F.col("u.names").alias("name"), F.col("u.lengths").alias("n"))
    unsure = unsure.join(names, "name", "left_semi").groupBy("doc", "length").agg(F.sum("n").alias("n"))
    each = sure.unionByName(unsure.withColumn("kind", F.lit("field")))
    parts = found.where("n > 0").select("doc", "n", "length").unionByName(unsure.select("doc", "n", "length")).groupBy("doc", "length").agg(F.max("n").alias("n"))
    coverage = parts.groupBy("doc").agg(F.max(F.least(F.lit(1.0), F.col("n") / F.col("length"))).alias("coverage"))
    kinds = each.groupBy("doc").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    return coverage.join(kinds, "doc").select(F.col("doc").alias(doc_id), "coverage", "kinds")


def without_residue(documents: DataFrame, most: float = 0.0, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose residue covers no more than ``most`` of them; null and empty texts stay."""
    bad = residue(documents, doc_id=doc_id, text=text).where(F.col("coverage") > most).select(doc_id)
    return documents.join(bad, doc_id, "left_anti")
