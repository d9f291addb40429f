"""Operator 5, quality rules: base counts of words, symbols and repeats, then tokeniser fertility.

Three public vocabularies measure each whole text: byte-level BPE for English and for many languages, and
pieces with byte fallback. Each gives characters per token, the share of tokens that are only part of a
character (byte-level) or byte fallback (pieces) and the entropy of its token distribution in bits. A text
is kept if its base counts pass and each measure of each vocabulary lies in that vocabulary's band of its
language or, where the language has none or is unknown, of its main script. The measures in the result are
those of the first vocabulary; the others read only texts that have passed so far.

The bands of en, de, fr, es and of Latin script are learnt (``learn_bands``) from a bounded sample: rows
labelled quality = 1 that pass the base counts, up to SAMPLE of each language by MD5 of doc_id, of the table
sf0.1. Each limit is the sample's extreme and SLACK of its range; the byte share has one limit for all,
since good text may quote another language. Entropy grows with length, so it is judged by its distance from
a parabola over log2 of the tokens. Two limits are wide on purpose: characters per token have no upper limit
but 8, and the upper slack of entropy is the whole range, since good prose with more words than the
sample's exceeds both. The lower entropy limit holds below the sample's FLUENT quantile of characters per
token only: symbols and separators lower both measures, while plain prose of few words reads well; above it
the floor is LEAST_ENTROPY. Other scripts have no labelled rows in the given tables; their bands are wide
guesses that catch only what the vocabulary cannot read.

Defined cases: null text counts as empty and fails (fewer than 50 words); measures of a text without
tokens are 0; entropy is judged from MIN_TOKENS tokens on only; a null or unknown language is judged by
script; very long texts and runs of blanks are encoded whole, in segments cut where the vocabulary cannot
tell; a null doc_id is a row like others; repeated rows are judged alike; an empty table gives an empty result; extra columns are ignored
by ``judge`` and kept by ``keep_good``.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.llm import _blocks as B
from wavegrid.llm._store import give_back, share, ship
from wavegrid.llm._text import Words, chunks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VOCABULARIES = (VOCABULARY, "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", "/opt/tokenizers/piece_bpe_32k.model")
MIN_WORDS = 50
REPEAT_PERCENT = 50
MIN_TOKENS = 50
SYMBOLS = b"#*$%&|<>"


SAMPLE = 2000
SLACK = 0.2
FLUENT = 0.95
LEAST_ENTROPY = 3.0


@dataclass(frozen=True)
class Band:
    """Closed ranges of the three measures; entropy is counted from the curve of log2(tokens)."""

    chars_per_token: tuple[float, float]
    byte_share: tuple[float, float]
    entropy: tuple[float, float]
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    log_tokens: tuple[float, float] = (0.0, 0.0)  # where the curve was learnt; constant outside
    fluent: float = 8.0  # from so many characters a token on, low entropy passes down to LEAST_ENTROPY

    def holds(self, n: int, chars: float, share: float, entropy: float) -> bool:
        if not (self.chars_per_token[0] <= chars <= self.chars_per_token[1] and self.byte_share[0] <= share <= self.byte_share[1]):
            return False
        if n < MIN_TOKENS:
            return True
        x = min(max(math.log2(n), self.log_tokens[0]), self.log_tokens[1])
        off = entropy - ((self.curve[0] * x + self.curve[1]) * x + self.curve[2])
        return off <= self.entropy[1] and (off >= self.entropy[0] or (chars >= self.fluent and entropy >= LEAST_ENTROPY))


def learn_band(m: np.ndarray) -> Band:
    """Band of good texts; m has a row (tokens, characters per token, byte share, entropy) for each."""
    x = np.log2(m[:, 0])
    curve = np.polyfit(x, m[:, 3], 2)
    off = m[:, 3] - np.polyval(curve, x)
    r = lambda *v: tuple(round(float(a), 4) for a in v)
    return Band(
        r(m[:, 1].min() - SLACK * np.ptp(m[:, 1]), 8),
        r(0, m[:, 2].max() + SLACK * np.ptp(m[:, 2])),
        r(off.min() - SLACK * np.ptp(off), off.max() + np.ptp(off)),
        r(*curve),
        r(x.min(), x.max()),
        *r(np.quantile(m[:, 1], FLUENT)),
    )


def shared_share(bands: dict[str, Band]) -> dict[str, Band]:
    """All bands with the byte share of the one named latin."""
    return {k: replace(b, byte_share=bands["latin"].byte_share) for k, b in bands.items()}


@dataclass(frozen=True)
class Bands:
    languages: dict[str, Band] = field(
        default_factory=lambda: {
            "de": Band((2.1355, 8.0), (0.0, 0.188), (-0.3967, 1.1461), (-0.0309, 0.7612, 2.091), (7.1497, 13.6311), 2.4595),
            "en": Band((2.2462, 8.0), (0.0, 0.188), (-0.4442, 1.0273), (-0.0372, 0.9225, 1.3215), (6.7682, 13.3062), 2.7433),
            "es": Band((1.8635, 8.0), (0.0, 0.188), (-0.5428, 1.6969), (-0.0334, 0.8157, 1.6951), (7.1997, 12.9723), 2.1595),
            "fr": Band((1.9196, 8.0), (0.0, 0.188), (-0.5041, 1.5478), (-0.0265, 0.6539, 2.5961), (7.1085, 13.7118), 2.2773),
        }
    )
    scripts: dict[str, Band] = field(
        default_factory=lambda: {
            "latin": Band((1.7517, 8.0), (0.0, 0.188), (-0.7341, 1.5154), (-0.0353, 0.8586, 1.6517), (6.7682, 13.7118), 2.7283),
            "alphabetic": Band((0.4, 6.0), (0.0, 0.95), (2.5, 15.0)),
            "ideographic": Band((0.25, 4.0), (0.0, 1.0), (2.5, 15.0)),
            "none": Band((0.2, 8.0), (0.0, 1.0), (2.0, 15.0)),
        }
    )


#: Wide guesses for the scripts without labelled rows.
OTHER_SCRIPTS = {k: v for k, v in Bands().scripts.items() if k != "latin"}
#: The bands of each of VOCABULARIES.
BANDS = (
    Bands(),
    Bands(
        {
            "de": Band((2.4552, 8.0), (0.0, 0.04), (-0.3707, 1.2023), (-0.0332, 0.8216, 1.805), (6.9773, 13.4493), 2.7836),
            "en": Band((2.2244, 8.0), (0.0, 0.04), (-0.4954, 1.221), (-0.0377, 0.9406, 1.2135), (6.7415, 13.3062), 2.7285),
            "es": Band((2.2415, 8.0), (0.0, 0.04), (-0.5593, 1.5353), (-0.0366, 0.8837, 1.472), (6.9425, 12.7576), 2.5039),
            "fr": Band((2.0243, 8.0), (0.0, 0.04), (-0.5064, 1.4535), (-0.0317, 0.7804, 2.0042), (6.9887, 13.5706), 2.4868),
        },
        {
            "latin": Band((1.9695, 8.0), (0.0, 0.04), (-0.635, 1.4241), (-0.0366, 0.9026, 1.4065), (6.7415, 13.5706), 2.7352),
            **OTHER_SCRIPTS,
        },
    ),
    Bands(
        {
            "de": Band((2.2856, 8.0), (0.0, 0.0529), (-0.3922, 1.2878), (-0.0315, 0.7758, 1.9927), (7.0334, 13.4921), 2.7018),
            "en": Band((2.0586, 8.0), (0.0, 0.0529), (-0.4213, 0.907), (-0.0373, 0.9184, 1.3222), (6.7549, 13.314), 2.7092),
            "es": Band((2.055, 8.0), (0.0, 0.0529), (-0.5198, 1.5869), (-0.0378, 0.9095, 1.3395), (7.0, 12.8386), 2.3653),
            "fr": Band((1.8562, 8.0), (0.0, 0.0529), (-0.565, 1.4779), (-0.0317, 0.7702, 2.0083), (7.0444, 13.6114), 2.4236),
        },
        {
            "latin": Band((1.8, 8.0), (0.0, 0.0529), (-0.6532, 1.6168), (-0.036, 0.8781, 1.5205), (6.7549, 13.6114), 2.7019),
            **OTHER_SCRIPTS,
        },
    ),
)


def load_vocabularies(paths: tuple[str, ...] = VOCABULARIES) -> tuple[list[tuple[str, bytes]], str]:
    """(name and content of each file, split pattern); read by the driver and broadcast, a few MB."""
    from public_tokenizers import PATTERN

    out = []
    for path in paths:
        with open(path, "rb") as f:
            out.append((path, f.read()))
    return out, PATTERN


def main_script(text: str) -> str:
    """Where most of the letters are: latin, other alphabetic, ideographic, or none."""
    if not text:
        return "none"
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "none"
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    latin = int((((c | 32) >= 97) & ((c | 32) <= 122)).sum() + ((c >= 0xC0) & (c < 0x250)).sum())
    ideographic = int((((c >= 0x3040) & (c < 0xA000)) | ((c >= 0xAC00) & (c < 0xD7B0)) | ((c >= 0x20000) & (c < 0x32000))).sum())
    other = int(((c >= 0x250) & (c < 0x2000)).sum())
    most = max(latin, ideographic, other)
    return "none" if not most else "latin" if most == latin else "ideographic" if most == ideographic else "alphabetic"


def repeat_words(words: Words) -> np.ndarray:
    """Per text: words that stand in a 3-word window which the text has twice or more."""
    n = len(words.hash) - 2
    cover = np.zeros(len(words.hash), bool)
    if n > 0:
        h, t = words.windows(3)
        at = np.flatnonzero(words.text[:n] == words.text[2:])
        order = np.lexsort((h, t))
        same = (h[order][1:] == h[order][:-1]) & (t[order][1:] == t[order][:-1])
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for j in range(3):
            cover[at[twice] + j] = True
    return np.bincount(words.text[cover], minlength=words.n)


def duplicate_lines(raw: bytes) -> int:
    seen, n = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(b" \t\r\x0b\x0c"):
            seen.add(line)
    return n


#: Characters that are encoded at once, about; a text without single blanks between ASCII letters or digits is one segment.
SEGMENT = 1 << 18
_CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
#: Unicode's white space. Long runs of it are beyond the split pattern's engine.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{20000,}")


def segments(text: str, keep_blank: bool) -> Iterator[str]:
    """Parts of a text whose tokens are those of the text.

    Byte-level tokens hold a blank at their start only and pieces' word marks too, and neither vocabulary's
    tokens go on from a letter to a blank, so that a single blank between two words is a safe cut. It opens
    the second part for byte-level vocabularies; pieces get a mark of their own at a part's start instead.
    """
    start = 0
    while len(text) - start > SEGMENT:
        cut = _CUT.search(text, start + SEGMENT)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start() if keep_blank else cut.end()
    yield text[start:] if start else text


class Fertility:
    """Tokens, characters per token, byte-fallback share and entropy of whole texts by one vocabulary."""

    def __init__(self, name: str, content: bytes, pattern: str) -> None:
        self.byte_level = not name.endswith(".model")
        if not self.byte_level:
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.encode = lambda text: pieces.encode(text, num_threads=1)
            self.partial = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])
        else:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
            self.encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.encode = self._encode
            self.partial = np.zeros(max(ranks.values()) + 1, bool)
            for token, i in ranks.items():
                try:
                    token.decode()
                except UnicodeDecodeError:
                    self.partial[i] = True

    def _encode(self, text: str) -> list[int]:
        """A run of blanks up to its last one, or to the text's end, is one part of the split pattern; long ones are encoded as such, past the pattern."""
        if len(text) < 20_000:
            return self.encoding.encode_ordinary(text)
        out, start = [], 0
        for run in _BLANKS.finditer(text):
            stop = run.end() - (run.end() < len(text))
            out += self.encoding.encode_ordinary(text[start : run.start()])
            out += self.encoding._encode_single_piece(text[run.start() : stop])
            start = stop
        return out + self.encoding.encode_ordinary(text[start:])

    def __call__(self, texts: list[str]) -> dict[str, np.ndarray]:
        """A row for each text."""
        n = len(texts)
        keys, counts, waiting, held = [], [], [], 0
        parts = ((i, part) for i, text in enumerate(texts) for part in segments(text, self.byte_level))
        for i, part in chain(parts, [(-1, "")]):
            if i >= 0:
                waiting.append((i, self.encode(part)))
                held += len(part)
            if waiting and (i < 0 or held > 4 * SEGMENT):
                size = [len(x) for _, x in waiting]
                ids = np.fromiter(chain.from_iterable(x for _, x in waiting), np.int64, sum(size))
                k, c = B.counted(np.repeat([j for j, _ in waiting], size) << 20 | ids)
                keys.append(k), counts.append(c)
                waiting, held = [], 0
        k, c = B.summed(keys, counts)
        owner, token = k.astype(np.int64) >> 20, k.astype(np.int64) & ((1 << 20) - 1)
        total = np.bincount(owner, weights=c, minlength=n)
        share = c / np.maximum(total, 1)[owner]
        some = np.maximum(total, 1)
        return {
            "n_tokens": total.astype(np.int64),
            "chars_per_token": np.where(total > 0, np.array([len(x) for x in texts]) / some, 0.0),
            "byte_share": np.bincount(owner, weights=c * self.partial[token], minlength=n) / some,
            "entropy": np.abs(np.bincount(owner, weights=-share * np.log2(share), minlength=n)),
        }


MEASURES = ("n_tokens", "chars_per_token", "byte_share", "entropy")
#: Rows that are judged at once; bounds the Python copies of an Arrow batch.
ROWS = 512


class Judge:
    """Counts, measures and verdicts of texts; made once in each task."""

    def __init__(self, vocabularies: list[tuple[str, bytes]], pattern: str, bands: tuple[Bands, ...]) -> None:
        self.fertility = [Fertility(name, content, pattern) for name, content in vocabularies]
        self.bands = bands

    def _in_bands(self, at: int, measured: dict[str, np.ndarray], texts: list[str], langs: list[str | None]) -> np.ndarray:
        """Whether each text's measures hold by one vocabulary."""
        b = self.bands[at]
        of = lambda text, lang: b.languages.get(lang) or b.scripts[main_script(text)]
        return np.array([of(*x).holds(*m) for *x, m in zip(texts, langs, zip(*(measured[k].tolist() for k in MEASURES), strict=True), strict=True)], bool)

    def __call__(self, texts: list[str | None], langs: list[str | None], measure_all: bool = True) -> dict[str, np.ndarray]:
        """measure_all: also where the base counts fail."""
        raw = [(x or "").encode() for x in texts]
        n = len(raw)
        out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")}
        out |= {k: np.zeros(n) for k in MEASURES[1:]}
        for a, b in chunks(raw):
            words = Words(raw[a:b], lower=False)
            out["n_words"][a:b] = words.counts
            out["n_repeat_words"][a:b] = repeat_words(words)
        for i, x in enumerate(raw):
            out["word_chars"][i] = len(texts[i] or "") - (len(x) - len(x.translate(None, b" \t\n\r\x0b\x0c")))
            out["n_symbols"][i] = len(x) - len(x.translate(None, SYMBOLS))
            out["n_dup_lines"][i] = duplicate_lines(x)
        out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
        out["kept"] = ~out["base_failed"]
        for j, f in enumerate(self.fertility):
            at = np.flatnonzero(out["kept"] | (j == 0 and measure_all))
            some, mine = [texts[i] or "" for i in at], [langs[i] for i in at]
            measured = f(some)
            if j == 0:
                for k in MEASURES:
                    out[k][at] = measured[k]
            out["kept"][at] &= self._in_bands(j, measured, some, mine)
        return out


_FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
    "chars_per_token double, byte_share double, entropy double, base_failed boolean, kept boolean"
)


def judge(docs: DataFrame, vocabularies: tuple[str, ...] = VOCABULARIES, bands: tuple[Bands, ...] = BANDS) -> DataFrame:
    """doc_id with all counts, measures, base_failed and kept."""
    shared = share(docs.sparkSession, (*load_vocabularies(vocabularies), bands))  # three vocabulary files

    def run(batches):
        j = Judge(*shared())
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = j(part.column(1).to_pylist(), part.column(2).to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), **{k: pa.array(out[k]) for k in (f.split()[0] for f in _FIELDS.split(", "))}})
        del j
        give_back()

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text", "lang").mapInArrow(run, f"doc_id {kind}, {_FIELDS}")


def keep_good(docs: DataFrame, vocabularies: tuple[str, ...] = VOCABULARIES, bands: tuple[Bands, ...] = BANDS) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    shared = share(docs.sparkSession, (*load_vocabularies(vocabularies), bands))
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches):
        j = Judge(*shared())
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield part.filter(pa.array(j(part.column(text).to_pylist(), part.column(lang).to_pylist(), False)["kept"]))
        del j
        give_back()

    return docs.mapInArrow(run, docs.schema)


def learn_bands(docs: DataFrame, labels: DataFrame, vocabulary: str = VOCABULARY) -> dict[str, Band]:
    """Bands by language, and one named latin of all, from at most SAMPLE good rows a language."""
    good = docs.join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    measured = judge(good, (vocabulary,), (Bands(),)).where("not base_failed").join(good.select("doc_id", "lang"), "doc_id")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string"))))
    rows = measured.withColumn("place", place).where(F.col("place") <= SAMPLE).select("lang", "n_tokens", "chars_per_token", "byte_share", "entropy").collect()  # SAMPLE a language
    of = lambda lang: np.array([r[1:] for r in rows if lang in (r.lang, "latin")], np.float64)
    return shared_share({lang: learn_band(of(lang)) for lang in (*sorted({r.lang for r in rows}), "latin")})


ship(__name__)
