"""Secret scans: key patterns, and a token-efficiency test for random strings."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake.llm._frames import text_or_empty
from cipherlake.llm._text import column
from cipherlake.shipping import ship_package

# The contract's patterns and lengths, in the order in which kinds are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")
#: Characters of a random string at least, and of its longest part if it is made of several.
MIN_RANDOM, MIN_LONGEST = 16, 8
#: How much stricter the ratio is for letters alone, of both cases within and of one case (or a capital first): words
#: without spaces and syllables joined at random come near 1.8.
STRICTER_MIXED, STRICTER_ONE_CASE = 0.2, 0.35

#: Runs that may be a random string.
RUN = r"[A-Za-z0-9+/_=-]+"
#: The pre-tokenizer pattern of the byte-level BPE vocabularies.
PRE_TOKENS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))

_assign = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_access = re.compile(ACCESS)
_hex = re.compile(f"[0-9a-f]{{{MIN_HEX},}}")
_run = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RANDOM},}}")
_part = re.compile(r"[A-Za-z0-9]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, leftmost and non-overlapping within a kind."""
    out = []
    folded = text.lower()
    if any(word in folded for word in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _access.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(out)


def is_digest(run: str) -> bool:
    return len(run) in _DIGEST_LENGTHS and all(c in "0123456789abcdefABCDEF" for c in run)


def is_known_identifier(run: str) -> bool:
    """Digests (hex of a usual length), UUIDs, and runs without both letters and digits: not random secrets."""
    if not any(c.isdigit() for c in run) or not any(c.isalpha() for c in run):
        return True
    return is_digest(run) or _UUID.fullmatch(run) is not None


def encoder(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
    return tiktoken.Encoding("scan", pat_str=PRE_TOKENS, mergeable_ranks=table, special_tokens={})


def low_stretches(parts: list[tuple[int, int]], gains: list[float]) -> Iterator[tuple[int, int]]:
    """Stretches of whole parts that gain the most: from a part that gains, up to the highest sum before it is used up."""
    k = 0
    while k < len(parts):
        best, end, total, j = 0.0, k, 0.0, k
        while j < len(parts) and total >= 0:
            total += gains[j]
            j += 1
            if total >= 0 and gains[j - 1] >= 0 and total >= best:
                best, end = total, j
        if end > k:
            yield parts[k][0], parts[end - 1][1]
        k = max(end, k + 1)


def random_spans(run: str, encoding, max_ratio: float) -> Iterator[tuple[int, int]]:
    """Spans of a run that hold a random string: all of it, or else stretches of its parts between + / _ = -, so that
    words beside a key do not hide it."""

    def is_random(text: str) -> bool:
        ratio = max_ratio
        if text.isalpha():
            ratio -= STRICTER_ONE_CASE if text[1:].islower() or text.isupper() else STRICTER_MIXED
        elif is_known_identifier(text):
            return False
        return len(text) <= ratio * len(encoding.encode_ordinary(text))

    if is_random(run) and (len(run) >= 20 or max(map(len, _part.findall(run))) >= MIN_LONGEST):
        yield 0, len(run)
        return
    # Identifiers are no part of a stretch.
    known = [m.span() for m in _UUID.finditer(run)]
    blocks: list[list[tuple[int, int]]] = [[]]
    for m in _part.finditer(run):
        if any(a < m.end() and m.start() < b for a, b in known) or is_digest(m.group()):
            blocks.append([])
        else:
            blocks[-1].append(m.span())
    for parts in blocks:
        # What a part has in tokens beyond the ratio; separators do not count.
        gains = [max_ratio * len(encoding.encode_ordinary(run[a:b])) - (b - a) for a, b in parts]
        for a, b in low_stretches(parts, gains):
            longest = max(y - x for x, y in parts if a <= x and y <= b)
            if b - a >= MIN_RANDOM and longest >= MIN_LONGEST and is_random(run[a:b]):
                yield a, b


def scan(texts: list[str], encoding, max_ratio: float) -> Iterator[list[tuple[int, int, int]]]:
    """For each text its spans (start, kind, end), sorted; kind indexes KINDS."""
    for text in texts:
        found = base_spans(text)
        for m in _run.finditer(text):
            found += [(m.start() + a, 3, m.start() + b) for a, b in random_spans(m.group(), encoding, max_ratio)]
        yield sorted(found)


def scan_secrets(
    df: DataFrame, ranks_path: str, text_col: str = "text", id_col: str = "doc_id", max_ratio: float = 1.9
) -> DataFrame:
    """One row per input row: doc_id and `found`, an array of (kind, start, end, value), in code points, end exclusive.

    Kinds assign, access and hex are the base patterns. Kind random is the token-efficiency test: a run of 16 or
    more characters of [A-Za-z0-9+/_=-] that holds letters and digits, is no digest or UUID, and has at most
    `max_ratio` characters a token under the vocabulary at `ranks_path` (words have three or more, random strings
    under two); under 20 characters it needs a part of 8 or more without + / _ = -. Letters alone (without these
    too) pass at 0.2 less, or at 0.35 less if they are of one case or only the first is a capital; digits alone never
    do. Every run of every whole text is tested; where the whole run fails, its parts between + / _ = - are
    too, and stretches of neighbouring parts with many tokens (16 or more characters, one part of 8 or more), so a key
    in a path or behind an underscore is found and its span is the stretch. Words joined to a key without any
    separator still dilute it. A stretch takes in neighbours as short of words as the key, such as `v2/`.

    The vocabulary (under 1 MB) is read on the driver and shipped with the task. Rows are handled one by one, so
    memory is bounded by one Arrow batch. Null text is empty and gives no spans. Repeated rows give equal results;
    null ids are carried. Other columns are not read. An empty table gives an empty result.
    """
    ship_package(df.sparkSession)
    with open(ranks_path, "rb") as f:
        ranks = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(ranks)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])
        for batch in batches:
            texts = column(batch, "text").to_pylist()
            rows = [
                [{"kind": KINDS[k], "start": a, "end": b, "value": text[a:b]} for a, k, b in spans]
                for text, spans in zip(texts, scan(texts, encoding, max_ratio), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(rows, type=pa.list_(kind))], names=["doc_id", "found"]
            )

    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, found array<struct<kind:string,start:int,end:int,value:string>>")


def span_digest(found: DataFrame) -> DataFrame:
    """The contract's columns from `scan_secrets`' result."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("found", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        count("random").alias("n_random"),
    )


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """n_assign, n_access, n_hex and base_sha256 straight from the patterns; for tests."""
    text = text or ""
    out = []
    for k, (pattern, flags, group, least) in enumerate(
        ((ASSIGN, re.I | re.A, 2, MIN_ASSIGN), (ACCESS, 0, 0, MIN_ACCESS), (HEX, 0, 0, MIN_HEX))
    ):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, flags) if len(m.group(group)) >= least]
    out.sort()
    joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in out)
    return (*(sum(x[1] == k for x in out) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest())
