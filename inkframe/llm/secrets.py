"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty of other candidates.

Candidates of the method are runs of 16 or more key characters after something sensitive: a word in
the 48 characters before them (or before a `=` in them), or an adjoining candidate or assignment that
has such a word (lines of a PEM block, parts of a JWT). A candidate's novelty is the number of bytes
that it adds to the compressed neighbourhood, over its length, by a compressor primed with a dictionary
of code identifiers: usual ones, and the ``NAMES`` most frequent names before `=`, `(` or `[` in all texts
of the table (letters and underscores, at most 32 of them; the number bounds the dictionary's size, of
which a compressor can use little more). It is held against the entropy of random text in the candidate's own alphabet;
what the neighbourhood and the dictionary don't explain is reported as `novel`. Parts joined by dots
are one token: they are reported together. The short last line of a PEM block goes with the line before.

Null and empty texts have no spans. Spans are code points, the end exclusive. Equal texts of one table have
equal spans; names of equal frequency go by the alphabet. Repeated rows are scanned each, extra columns are
ignored (kept by `without_secrets`), an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, slices, small_batches

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_SENSITIVE = re.compile(r"passw|secret|token|api|key|auth|bearer|credential|private|signature|session", re.I | re.A)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_ADJOINS = re.compile(r"[\s.,\"'+\\#*>|]{1,32}")
_LETTERS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_LAST = re.compile(r"\s{1,32}([A-Za-z0-9+/]{1,15}={0,2})(?=\s{1,32}-----END)")
AROUND, NOVELTY, NAMES = 96, 0.9, 2000
IDENTIFIERS = (
    "abstract access account address algorithm append application argument array assert async attribute author await backend base64 batch bearer "
    "boolean buffer cache callback catch certificate class client cluster column commit config connection const constructor content context continue "
    "cookie create credential database debug default define delete description destination directory document domain double element email encoding "
    "endpoint entity environment error exception execute export extends false file filter float folder format function handler header host identifier "
    "implements import index initialize input instance integer interface iterator json key lambda length library license limit list local location "
    "logger login manager message metadata method module namespace network null number object operator option output override package parameter parse "
    "password path pattern payload permission port prefix primary private process profile property protected protocol provider public publish query "
    "queue random record redirect reference register release remote repository request resource response result return route schema scope script "
    "secret select sequence server service session signature source static status storage string struct submit subscribe suffix super switch system "
    "table target template thread timeout timestamp token transaction transfer true type undefined update upload url user utf8 value variable vector "
    "version virtual void volatile while window workflow write xml yaml 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ example test_"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the fixed patterns, sorted."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Novelty:
    """Marginal compressed bytes of strings, against their surroundings and a dictionary."""

    def __init__(self, dictionary: str = IDENTIFIERS):
        primed = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode("utf-8", "replace")))

    def share(self, around: str, candidate: str) -> float:
        return max(0, self.size(around + candidate) - self.size(around)) / len(candidate)


def random_share(candidate: str) -> float:
    """Bytes a character of random text in the alphabet that ``candidate`` shows."""
    if re.fullmatch(r"[0-9]+", candidate):
        size = 10
    elif re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", candidate):
        size = 16
    else:
        size = sum(n for n, kind in ((10, "[0-9]"), (26, "[a-z]"), (26, "[A-Z]")) if re.search(kind, candidate)) + len(set(candidate) & set("+/_=-"))
    if len(candidate) >= 4 * size:  # long enough to show each character
        size = len(set(candidate))
    return math.log2(max(2, size)) / 8


def _letter_pairs() -> dict[str, float]:
    """Bits of each letter after another, or first, by the words of the dictionary."""
    letters, words = "abcdefghijklmnopqrstuvwxyz", re.findall("[a-z]{3,13}", IDENTIFIERS)
    pairs = Counter(w[k : k + 2] for w in words for k in range(len(w) - 1))
    single = Counter("".join(words))
    total = sum(single.values()) + 26
    bits = {x: -math.log2((single[x] + 1) / total) for x in letters}
    for x in letters:
        after = sum(pairs[x + y] for y in letters)
        bits |= {x + y: -math.log2((pairs[x + y] + 5 * (single[y] + 1) / total) / (after + 5)) for y in letters}
    return bits


_BITS = _letter_pairs()


def _worded(candidate: str) -> bool:
    """Whether it is mostly letters whose pairs are more usual in words than in random letters."""
    runs = [r.lower() for r in _LETTERS.findall(candidate)]
    n = sum(map(len, runs))
    if 4 * n < 3 * len(candidate):
        return False
    return sum(_BITS[r[0]] + sum(_BITS[r[k : k + 2]] for k in range(len(r) - 1)) + 2 for r in runs) < 2 + n * math.log2(26)


def _is_novel(share: float, candidate: str) -> bool:
    """Words cost no less than letters at random where they are short, so short candidates must cost more;
    random ones do, as a compressor hardly finds their alphabet."""
    bound = random_share(candidate)
    return share >= max(NOVELTY * bound, min(bound, math.log2(26) / 8) * 0.95 + 4.7 / len(candidate))


def _sensitive(text: str, a: int, b: int) -> bool:
    inner = text.rfind("=", a, a + len(text[a:b].rstrip("=")))
    return bool(_SENSITIVE.search(text, max(0, a - 48), a if inner < 0 else inner))


def novel_spans(text: str, taken: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    if not _SENSITIVE.search(text):
        return []
    tokens: list[list[tuple[int, int, bool]]] = []  # candidates joined by dots, and whether each is novel
    at, reach, named, last = 0, 0, 0, -1  # the next of ``taken``, their ends, the end of the last sensitive stretch and candidate
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(taken) and taken[at][0] < b:
            start, kind, end = taken[at]
            reach, at = max(reach, end), at + 1
            if kind == 0 and start < a:
                named = max(named, end)
        joined = 0 < named < a and _ADJOINS.fullmatch(text, named, a) is not None
        if a < named or joined or _sensitive(text, a, b):
            named = max(named, b)
        else:
            continue
        if a < reach:
            named = max(named, reach)
            continue
        around = text[max(0, a - AROUND) : a] + " " + text[b : b + AROUND] + " "
        piece = (a, b, not _worded(m.group()) and _is_novel(novelty.share(around, m.group()), m.group()))
        if last + 1 == a and text[last] == ".":
            tokens[-1].append(piece)
        else:
            tokens.append([piece])
        last = b
    found = [(a, 3, b) for token in tokens if any(new for *_, new in token) for a, b, _ in token]
    ends = {b for _, _, b in found}
    return sorted(found + [(m.start(1), 3, m.end(1)) for m in _LAST.finditer(text) if m.start() in ends])


def dictionary_of(docs: DataFrame) -> str:
    """The usual identifiers and the most frequent names of all texts, these last, where matches are cheapest."""
    names = F.regexp_extract_all(F.col("text"), F.lit(r"(?<![A-Za-z0-9_])([A-Za-z_]{4,32})(?=\x20?[=(\[])"), F.lit(1))
    counts = docs.select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")
    rows = counts.orderBy(F.desc("n"), "name").limit(NAMES).collect()
    return " ".join([IDENTIFIERS, *[r["name"] for r in reversed(rows)]])


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with each stretch that spans cover replaced by the mark."""
    out, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


_OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_novel", pa.int64())])


def _scan(dictionary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                base = base_spans(text or "")
                novel = novel_spans(text or "", base, novelty)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((doc_id, *counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(sorted(base + novel)), len(novel)))
            yield arrow_rows(_OUT, **dict(zip(_OUT.names, zip(*rows, strict=True), strict=True)))

    return run


def secret_scan(docs: DataFrame) -> DataFrame:
    """A row for each document: counts of the fixed kinds, the digest of their spans, and all spans."""
    small_batches(docs.sparkSession)
    ddl = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel bigint"
    return docs.select("doc_id", "text").mapInArrow(_scan(dictionary_of(docs)), ddl)


def without_secrets(docs: DataFrame) -> DataFrame:
    """All rows of ``docs``, secrets in text replaced by a mark and n_chars (where there is one) counted anew."""
    small_batches(docs.sparkSession)
    dictionary = dictionary_of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sizes = batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else None
            for i, text in enumerate(texts):
                if text and (spans := [*(base := base_spans(text)), *novel_spans(text, base, novelty)]):
                    texts[i] = redact(text, spans)
                    if sizes:
                        sizes[i] = len(texts[i])
            columns = list(batch.columns)
            columns[batch.schema.get_field_index("text")] = pa.array(texts, batch.schema.field("text").type)
            if sizes is not None:
                columns[batch.schema.get_field_index("n_chars")] = pa.array(sizes, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
