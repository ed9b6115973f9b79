"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

A tokenizer's vocabulary packs ordinary text into few tokens, but random strings into
many, so a low ratio of characters to tokens exposes them. Candidates are runs of
letters, digits and the signs of base64 that hold letters; known digests (hexadecimal of
a digest's length), UUIDs and the like are excluded before the test. A name that begins
with a date is excluded if the date is one and the rest packs like words; joined words and
words with a short number are, if their letters do.

Every text is scanned whole, in one pass without a shuffle. Defined results for odd
input: null is scanned as an empty text and gives zero counts, the digest of an empty
string and no spans; repeated rows each give their row; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, only_model

KINDS = ("assign", "access", "hex", "random")
#: Where the public vocabularies lie on every machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters per token below which a candidate counts as random.
RATIO = 2.2
#: Shortest candidate, and shortest one without a digit or a capital behind its first letter: long words are of that kind.
SHORTEST, SHORTEST_PLAIN = 16, 20

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % SHORTEST)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Lengths in hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
#: A name that begins with a date, and the rest of it.
DATED = re.compile(r"(?:19|20)\d\d[-_/]?(?:0[1-9]|1[0-2])[-_/]?(?:0[1-9]|[12]\d|3[01])(?!\d)(.*)", re.S)
#: Words joined by signs, and a short number; a word and a short number.
JOINED = re.compile(r"(([A-Za-z]+[-_/]+)+[A-Za-z]*)\d{0,4}|([A-Za-z]+)\d{1,4}")
#: Split pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@only_model
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    found = []
    low = text.lower()
    if any(x in low for x in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def packs_badly(s: str, path: str, ratio: float) -> bool:
    return len(s) < ratio * len(encoder(path).encode_ordinary(s))


def identifier(s: str, path: str, ratio: float) -> bool:
    """Whether a candidate that the vocabulary packs badly is a name all the same."""
    if UUID.fullmatch(s):
        return True
    dated = DATED.fullmatch(s)
    if dated:
        rest = dated[1].strip("-_/=")
        return not rest or not packs_badly(rest, path, ratio) or rest.isdigit() and len(rest) <= 9
    m = JOINED.fullmatch(s)
    return bool(m) and not packs_badly(re.sub("[-_/]+", " ", m[1] or m[3]).strip(), path, ratio)


def random_spans(text: str, taken: list[tuple[int, int, int]], path: str, ratio: float) -> list[tuple[int, int, int]]:
    """Candidates outside the spans already taken that the vocabulary packs badly."""
    found = []
    for m in CANDIDATE.finditer(text):
        s, (a, b) = m.group(), m.span()
        if len(s) < SHORTEST_PLAIN and not re.search("[0-9]|(?<=.)[A-Z]", s):
            continue
        if not re.search(r"[A-Za-z]", s) or any(x < b and a < y for x, _, y in taken):
            continue
        if len(s) in DIGESTS and re.fullmatch("[0-9a-fA-F]+", s):
            continue
        if packs_badly(s, path, ratio) and not identifier(s, path, ratio):
            found.append((a, 3, b))
    return found


def scan_text(text: str | None, path: str, ratio: float) -> tuple[list, list]:
    base = base_spans(text or "")
    return base, sorted(base + random_spans(text or "", base, path, ratio))


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, path: str = VOCABULARY, ratio: float = RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_spans and spans (kind:start:end, by start, then kind)."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, text in zip(batch["doc_id"], batch["text"]):
                base, spans = scan_text(text, path, ratio)
                n = [sum(k == j for _, k, _ in spans) for j in range(4)]
                rows.append((i, *n, spell(base), spell(spans)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_spans", "spans"]).astype({"doc_id": batch["doc_id"].dtype})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_random long, base_spans string, spans string")


def redact(docs: DataFrame, path: str = VOCABULARY, ratio: float = RATIO, mark: str = "[secret]") -> DataFrame:
    """The documents with every secret replaced; overlapping spans are replaced as one. Other columns stay."""

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        parts, at = [], 0
        for a, _, b in scan_text(text, path, ratio)[1]:
            if a >= at:
                parts += [text[at:a], mark]
            at = max(at, b)
        return "".join(parts) + text[at:] if parts else text

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        found = texts.map(clean, na_action="ignore")
        give_back()
        return found

    return docs.withColumn("text", cleaned("text"))


def report(docs: DataFrame, **options) -> DataFrame:
    """scan(), with the digest of the fixed patterns' spans in place of their list."""
    return scan(docs, **options).withColumn("base_sha256", F.sha2("base_spans", 256)).drop("base_spans")


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
