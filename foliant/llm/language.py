"""Languages of documents and lines: unigram piece models, summed over all segmentations of each word."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"

# The languages told apart, with the codes and words that name them.
NAMES = """
en eng english anglais englisch
de deu ger german deutsch allemand
fr fra fre french français francais französisch
es spa spanish español espanol castellano castilian spanisch
pt por portuguese português portugues portugiesisch
it ita italian italiano italienisch
nl nld dut dutch nederlands flemish vlaams
ru rus russian русский russisch
zh zho chi cmn chinese mandarin 中文 汉语 漢語 chinesisch
"""
LANGUAGES = [line.split()[0] for line in NAMES.split("\n") if line]
LABELS = {name: line.split()[0] for line in NAMES.split("\n") for name in line.split()}
# Labels that name no language.
NO_LABEL = {"", "und", "unknown", "none", "null", "n/a", "na", "mul", "mis", "zxx", "other", "?", "-"}

_IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_])(?:[A-Za-z]*+[0-9_][A-Za-z0-9_]*+|[A-Z]{2,}+(?![a-zà-ÿ]))")
_LETTERS = re.compile(r"[^\W\d_]+")
_IDEOGRAPHS = re.compile(r"[⺀-⿟々〇㐀-䶿一-鿿豈-﫿]")
_LONGEST_WORD = 24


def named(label: str | None) -> str | None:
    """The code a label names, in whatever code, case, region or word; None if it names none; else the label itself."""
    whole = (label or "").strip().casefold()
    if whole in NO_LABEL:
        return None
    first = re.split(r"[-_ (,;/.]", whole, maxsplit=1)[0]
    return LABELS.get(whole) or LABELS.get(first) or (None if first in NO_LABEL else whole)


def prose_words(line: str) -> list[str]:
    """The words of a line that carry a language, in lower case; none if the line is no prose of at least 20 characters.

    Identifiers (with digits, underscores or in capitals alone) carry none. A line written in capitals
    throughout is read as prose if its words are long enough. Long runs without blanks are taken in parts.
    """
    if len(line.strip()) < 20:
        return []
    found = _LETTERS.findall(_IDENTIFIER.sub(" ", line).lower())
    if line.isupper() and not any(len(w) > 1 for w in found):
        found = [w.lower() for w in re.findall(r"(?<![\w.])[^\W\d_]+(?![\w])", line) if len(w) > 1]
        if len(found) < 4 or sum(map(len, found)) < 3.5 * len(found):
            return []
    weight = 0
    for w in found:
        weight += len(w) if w.isascii() and len(w) > 1 else 2 * len(_IDEOGRAPHS.findall(w)) or len(w) if len(w) > 1 or _IDEOGRAPHS.match(w) else 0
        if weight >= 5:
            break
    else:
        return []
    if max(map(len, found)) <= _LONGEST_WORD:
        return found
    return [w[i : i + _LONGEST_WORD] for w in found for i in range(0, len(w), _LONGEST_WORD)]


def _script(ch: str) -> str:
    cp = ord(ch)
    return "latin" if cp < 0x250 else "greek" if cp < 0x400 else "cyrillic" if cp < 0x530 else "han" if _IDEOGRAPHS.match(ch) else "other"


@lru_cache(2)
def vocabulary(path: str) -> dict[str, int]:
    """Piece → number, for the pieces of the public vocabulary; a character outside it counts as its script."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    names = sorted({p.lower() for p in pieces}) + [f"<{s}>" for s in ("latin", "greek", "cyrillic", "han", "other")]
    return {p: i for i, p in enumerate(names)}


class _Lattice:
    """The pieces of a set of words: for each end position and piece length the piece's number, grouped by word length."""

    def __init__(self, words: list[str], pieces: dict[str, int]):
        most = max(map(len, pieces))
        self.groups: list[tuple[np.ndarray, np.ndarray]] = []
        by_size = defaultdict(list)
        for i, w in enumerate(words):
            by_size[len(w) + 1].append(i)
        get, none = pieces.get, len(pieces)
        for size, rows in by_size.items():
            width = min(most, size)
            ids = np.full((len(rows), size + 1, width + 1), none, dtype=np.int32)
            for r, i in enumerate(rows):
                w = "▁" + words[i]
                for end in range(1, size + 1):
                    for n in range(1, min(width, end) + 1):
                        p = get(w[end - n : end])
                        if p is not None:
                            ids[r, end, n] = p
                        elif n == 1:
                            ids[r, end, 1] = pieces[f"<{_script(w[end - 1])}>"]
            self.groups.append((np.array(rows), ids))

    def forward(self, p: np.ndarray, ids: np.ndarray) -> np.ndarray:
        a = np.zeros((ids.shape[1], len(ids), p.shape[1]))
        a[0] = 1
        for end in range(1, ids.shape[1]):
            for n in range(1, min(ids.shape[2] - 1, end) + 1):
                a[end] += a[end - n] * p[ids[:, end, n]]
        return a

    def score(self, p: np.ndarray, count: int) -> np.ndarray:
        """log P(word | language), summed over every segmentation."""
        out = np.zeros((count, p.shape[1]))
        for rows, ids in self.groups:
            out[rows] = np.log(self.forward(p, ids)[-1])
        return out

    def expected(self, p: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by each language, over all segmentations of the weighted words."""
        uses = np.zeros_like(p)
        for rows, ids in self.groups:
            a = self.forward(p, ids)
            size = ids.shape[1] - 1
            b = np.zeros_like(a)
            b[size] = 1
            per = weights[rows] / a[size]
            for end in range(size, 0, -1):
                for n in range(1, min(ids.shape[2] - 1, end) + 1):
                    q = p[ids[:, end, n]]
                    np.add.at(uses, ids[:, end, n], per * a[end - n] * q * b[end])
                    b[end - n] += q * b[end]
        return uses


class LanguageModel:
    """Piece probabilities per language; fitted on (label, text) pairs of which some labels may be wrong."""

    def __init__(self, path: str = VOCABULARY):
        self.path = path
        self.p: np.ndarray | None = None
        self._at: dict[str, int] = {}
        self._rows: np.ndarray | None = None

    def _estimate(self, lattice: _Lattice, weights: np.ndarray, rounds: int = 3) -> None:
        none = len(vocabulary(self.path))
        if self.p is None:
            self.p = np.full((none + 1, len(LANGUAGES)), 1 / none)
            self.p[none] = 0
        for _ in range(rounds):
            uses = lattice.expected(self.p, weights)
            uses[none] = 0
            every = uses.sum(1, keepdims=True) + 0.05
            every[none] = 0
            every /= every.sum()
            own = uses + 200.0 * every  # languages share what they haven't shown a preference for
            self.p = own / own.sum(0)

    def fit(self, labelled: Iterable[tuple[str, str]], passes: int = 3) -> LanguageModel:
        """Fit on the prose lines of the sample; after each pass the lines are labelled anew by what they read like."""
        lines = [(LANGUAGES.index(label), Counter(w)) for label, text in labelled for line in text.split("\n") if (w := prose_words(line))]
        words = sorted({w for _, c in lines for w in c})
        at = {w: i for i, w in enumerate(words)}
        lattice = _Lattice(words, vocabulary(self.path))
        labels = [label for label, _ in lines]
        for k in range(passes):
            weights = np.zeros((len(words), len(LANGUAGES)))
            for label, (_, c) in zip(labels, lines, strict=True):
                for w, n in c.items():
                    weights[at[w], label] += n
            self._estimate(lattice, weights)
            if k < passes - 1:
                score = lattice.score(self.p, len(words))
                labels = [int(np.argmax(sum(n * score[at[w]] for w, n in c.items()))) for _, c in lines]
        seen = np.bincount(labels, minlength=len(LANGUAGES)) > 0
        self.p[:, ~seen] = 0  # a language without a single line can't be told
        self._at, self._rows = {}, None
        return self

    def __getstate__(self) -> dict:
        return {"path": self.path, "p": self.p, "_at": {}, "_rows": None}

    def scores(self, lines: list[list[str]]) -> np.ndarray:
        """log P(line | language) of each line; no line is empty."""
        if len(self._at) > 200_000:  # bounds memory only: a word left out is scored again
            self._at, self._rows = {}, None
        new = [w for w in dict.fromkeys(w for words in lines for w in words) if w not in self._at]
        if new:
            with np.errstate(divide="ignore"):
                rows = _Lattice(new, vocabulary(self.path)).score(self.p, len(new))
            self._at.update(zip(new, range(len(self._at), len(self._at) + len(new)), strict=True))
            self._rows = rows if self._rows is None else np.concatenate([self._rows, rows])
        if not lines:
            return np.zeros((0, len(LANGUAGES)))
        get = self._at.__getitem__
        at = np.fromiter((get(w) for words in lines for w in words), dtype=np.int64)
        return np.add.reduceat(self._rows[at], np.cumsum([0, *map(len, lines[:-1])]))

    @staticmethod
    def tell(scores: np.ndarray) -> np.ndarray:
        """Posterior of each line of one document; the document's own mixture of languages is the prior."""
        like = np.exp(scores - scores.max(1, keepdims=True))
        mixture = np.full(like.shape[1], 1 / like.shape[1])
        for _ in range(3):
            post = like * mixture
            post /= post.sum(1, keepdims=True)
            mixture = (post.sum(0) + 0.05) / (len(like) + 0.05 * like.shape[1])
        return post


def training_sample(docs: DataFrame, doc: str, text: str, label: str, per_language: int = 400, longest: int = 20_000) -> list[tuple[str, str]]:
    """At most ``per_language`` labelled texts of at most ``longest`` characters for each language, chosen by a hash of the id.

    This bound (3,600 texts, 72 million characters at the very most) holds at every size of the corpus.
    """
    first = F.lower(F.element_at(F.split(F.trim(F.col(f"`{label}`")), r"[-_ (,;/.]"), 1))
    table = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    rows = docs.select(table[first].alias("code"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{doc}`")).alias("h")).filter((F.length("text") <= longest) & F.col("code").isNotNull())
    best = rows.withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy("h", "text"))).filter(F.col("k") <= per_language)
    return [(r.code, r.text) for r in best.select("code", "text").orderBy("code", "text").collect()]


def _groups(batch: pa.RecordBatch, most: int = 500_000) -> Iterator[list[tuple[int, str | None, list[tuple[int, list[str]]]]]]:
    """(id, label, numbered prose lines) of the documents with any, in groups of about ``most`` characters, so that memory is bounded."""
    part, size = [], 0
    for d, t, said in zip(*[c.to_pylist() for c in batch.columns], strict=True):
        numbered = [(no, w) for no, line in enumerate(t.split("\n"), 1) if (w := prose_words(line))]
        if numbered:
            part.append((d, said, numbered))
            size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def languages(docs: DataFrame, doc: str, text: str, label: str, model: LanguageModel | None = None, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """(doc_id, line_no, lang, confidence, label_ok, mixed, letters): line_no 0 is the document, others its prose lines.

    A document's language is that of most of its prose lines (of equally many, the one with more letters; then the first
    in the order of ``LANGUAGES``); its confidence is the mean posterior of it. ``label_ok`` says whether the label names
    it, ``mixed`` whether its lines are in more than one language. Documents without prose, null ids and null texts give no rows.
    Whole texts are scored where they are read; nothing is shuffled. The model is ``piece count x languages`` numbers.
    """
    spark = docs.sparkSession
    schema = "doc_id bigint, line_no bigint, lang string, confidence double, label_ok boolean, mixed boolean, letters bigint"
    base = docs.select(F.col(f"`{doc}`").cast("bigint").alias("d"), F.col(f"`{text}`").alias("t"), F.col(f"`{label}`").cast("string").alias("l"))
    if model is None:
        sample = training_sample(docs, doc, text, label)
        if not sample:
            return spark.createDataFrame([], schema)
        model = LanguageModel(vocabulary_path).fit(sample)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows = []
            for part in _groups(batch):
                scores, at = m.scores([w for _, _, numbered in part for _, w in numbered]), 0
                for d, said, numbered in part:
                    post = m.tell(scores[at : at + len(numbered)])
                    at += len(numbered)
                    top = post.argmax(1)
                    size = [sum(map(len, w)) for _, w in numbered]
                    lines, letters = np.bincount(top, minlength=len(LANGUAGES)), np.bincount(top, weights=size, minlength=len(LANGUAGES))
                    main = max(range(len(LANGUAGES)), key=lambda k: (lines[k], letters[k], -k))  # noqa: B023
                    ok, mixed = named(said) == LANGUAGES[main], int((lines > 0).sum()) > 1
                    rows.append((d, 0, LANGUAGES[main], float(post[:, main].mean()), ok, mixed, sum(size)))
                    rows += [(d, no, LANGUAGES[k], float(q[k]), ok, mixed, n) for (no, _), k, q, n in zip(numbered, top.tolist(), post, size, strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.bool_(), pa.int64()), strict=True)], names=["doc_id", "line_no", "lang", "confidence", "label_ok", "mixed", "letters"])

    return base.filter("d IS NOT NULL AND t IS NOT NULL").mapInArrow(run, schema)
