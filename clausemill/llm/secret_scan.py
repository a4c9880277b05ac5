"""Secrets in texts: three plain patterns, and encoded keys and tokens that are reported only if their structure is right.

Patterns (leftmost, not overlapping, each kind by itself; spans are of the whole match): assign, a name such as `token`, then `:` or
`=`, then a value of 6 or more characters; access, `AKIA` and 20 or more characters; hex, 24 or more digits `0-9a-f`.

Structural confirmation adds, where a candidate decodes and parses completely:

* pem: a block between BEGIN and END ... PRIVATE KEY whose body is one of the encodings below, or an encrypted body under its headers;
* der: base64 or hex of a private key, i.e. nested ASN.1 lengths that fit each other exactly: PKCS#1 (version and eight
  integers, the modulus as long as its factors together), PKCS#8 (version, algorithm, octets; also encrypted), SEC1 (version 1, octets);
* ssh: base64 of an OpenSSH key file: its magic word and length-prefixed fields to the last byte;
* wrapped: base64 of a PEM block, as configuration files hold it;
* jwt: three parts, of which the first is a JSON object with a known `alg`, the second a JSON object, and the third has the
  length that the algorithm signs with.

A candidate may be glued to what stands before or after it: keys are looked for wherever their first bytes can be, and the
length inside says where they end.  Spans within a longer one of these kinds are left out.  Plain spans always stay.

Texts are scanned by Arrow's linear-time patterns first; only those that can hold something are searched in Python.  One pass,
no shuffle; a row's result depends on its text alone.

Defined cases: null text is empty; an empty text has no spans; repeated rows each get a row; an empty table gives none; null ids
are kept; other columns play no part.  A text of any length is searched whole, in time proportional
to it; a key is below 64 KB.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.llm.shared import small_batches
from clausemill.llm.words import slices

PLAIN = ("assign", "access", "hex")
KINDS = (*PLAIN, "pem", "der", "ssh", "wrapped", "jwt")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
_RUN64 = re.compile("[A-Za-z0-9+/_-]{40,}={0,2}")
_RUN16 = re.compile("[0-9A-Fa-f]{48,}")
_MARK = re.compile("-----(BEGIN|END) ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
_DOTTED = re.compile("[A-Za-z0-9_.-]{20,}")
_WITHIN = re.compile("M|b3BlbnNzaC1rZXkt|LS0tLS1CRUdJTi")
# What a text must hold for a kind to be possible, in patterns that run in linear time.
_MAY_HOLD = {
    "assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]",
    "access": "AKIA[A-Z0-9]",
    "hex": "[0-9a-f]{24}",
    "pem": "PRIVATE KEY-----",
    "run": "[A-Za-z0-9+/_-]{40}",
    "jwt": r"e[wy][A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]",
}
# Bytes that the algorithms of signed tokens sign with; at least so many for RSA.
_SIGNED = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES256K": (64,), "ES384": (96,), "ES512": (132,), "EdDSA": (64, 114)}
_RSA = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512")
_SSH = b"openssh-key-v1\0"


def _unhex(text: str) -> bytes:
    return bytes.fromhex(text[: len(text) // 2 * 2])


def _unbase64(text: str) -> bytes:
    """Bytes of base64 in either alphabet, padded or not; what is left over of the last four is dropped."""
    bare = text.rstrip("=").replace("-", "+").replace("_", "/")
    bare = bare[: len(bare) - 1] if len(bare) % 4 == 1 else bare
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except binascii.Error:
        return b""


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, where its content begins, where it ends) of the DER element at a place, if its length is well formed and fits."""
    if at + 2 > end:
        return None
    size, start = data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or start + n > end or data[start] == 0:
            return None
        size, start = int.from_bytes(data[start : start + n]), start + n
        if size < 0x80:
            return None
    return (data[at], start, start + size) if start + size <= end else None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill a stretch exactly."""
    out = []
    while at < end:
        x = _element(data, at, end)
        if x is None or len(out) > 64:
            return None
        out.append(x)
        at = x[2]
    return out


def _number(data: bytes, x: tuple[int, int, int]) -> int:
    return int.from_bytes(data[x[1] : x[2]], signed=True)


def private_key_end(data: bytes, deep: int = 0) -> int:
    """Where the DER private key at the start of data ends; 0 if there is none."""
    if data[:1] != b"\x30":
        return 0
    outer = _element(data, 0, len(data))
    parts = _elements(data, outer[1], outer[2]) if outer else None
    if not parts or len(parts) < 2:
        return 0
    tags = [x[0] for x in parts]
    if tags[0] == 0x30 and tags == [0x30, 0x04]:  # encrypted PKCS#8: algorithm with parameters, octets in whole blocks
        inner, size = _elements(data, *parts[0][1:]), parts[1][2] - parts[1][1]
        return outer[2] if inner and inner[0][0] == 0x06 and len(inner) == 2 and inner[1][0] == 0x30 and size >= 16 and size % 8 == 0 else 0
    if tags[0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return 0
    version = _number(data, parts[0])
    if version in (0, 1) and len(parts) >= 9 and set(tags[1:9]) == {0x02}:  # PKCS#1
        n, e, d, p, q = (_number(data, x) for x in parts[1:6])
        return outer[2] if n > 0 and n.bit_length() >= 512 and 1 < e and 1 < d and p > 1 and q > 1 and p * q == n else 0
    if version in (0, 1) and tags[1:3] == [0x30, 0x04] and not deep:  # PKCS#8
        inner = _elements(data, *parts[1][1:])
        if not inner or inner[0][0] != 0x06 or len(inner) > 2:
            return 0
        body = data[parts[2][1] : parts[2][2]]
        octets = _element(body, 0, len(body))
        whole = octets is not None and octets[2] == len(body) and (octets[0] == 0x04 or octets[0] == 0x02 or private_key_end(body, 1) == len(body))
        return outer[2] if whole else 0
    if version == 1 and tags[1] == 0x04 and set(tags[2:]) <= {0xA0, 0xA1}:  # SEC1
        size = parts[1][2] - parts[1][1]
        named = all(_elements(data, x[1], x[2]) for x in parts[2:])
        return outer[2] if 20 <= size <= 72 and named and (len(parts) > 2 or deep) else 0
    return 0


def ssh_key_end(data: bytes) -> int:
    """Where an OpenSSH private key at the start of data ends; 0 if there is none."""
    if not data.startswith(_SSH):
        return 0
    at, names = len(_SSH), []

    def field(at: int) -> tuple[bytes, int]:
        if at + 4 > len(data):
            raise ValueError("cut short")
        end = at + 4 + int.from_bytes(data[at : at + 4])
        if end > len(data):
            raise ValueError("cut short")
        return data[at + 4 : end], end

    try:
        for _ in range(3):  # cipher, key derivation, its options
            name, at = field(at)
            names.append(name)
        keys, at = int.from_bytes(data[at : at + 4]), at + 4
        if not 1 <= keys <= 16 or not names[0].isascii() or not names[0]:
            return 0
        for _ in range(keys):
            public, at = field(at)
            if not 4 < len(public):
                return 0
        secret, at = field(at)
    except ValueError:
        return 0
    plain = names[0] != b"none" or (len(secret) >= 8 and secret[:4] == secret[4:8])  # the two check words are equal
    return at if plain and len(secret) >= 8 and len(secret) % 8 == 0 else 0


def _pem_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans of confirmed blocks: an END mark and the BEGIN mark right before it, of the same label."""
    begun = None
    for m in _MARK.finditer(text):
        if m[1] == "BEGIN":
            begun = m
            continue
        if begun is not None and begun[2] == m[2] and _is_key(text[begun.end() : m.start()]):
            yield begun.start(), m.end()
        begun = None


def _is_key(body: str) -> bool:
    lines = [x.strip() for x in body.replace("\\n", "\n").replace("\\r", "").splitlines()]
    data = _unbase64("".join(x for x in lines if ": " not in x).replace(" ", ""))
    locked = any(x.startswith("Proc-Type: 4,ENCRYPTED") for x in lines) and any(x.startswith("DEK-Info: ") for x in lines)
    return (locked and len(data) >= 32 and len(data) % 8 == 0) or (data != b"" and len(data) in (private_key_end(data), ssh_key_end(data)))


def _size(head: bytes) -> int:
    """Bytes of the private key that may begin with head, by its first length (below 64 KB) and what follows it; 0 if none can."""
    if len(head) < 8 or head[0] != 0x30:
        return 0
    more = head[1] & 0x7F if head[1] >= 0x80 else 0
    if more > 2 or head[1] == 0x80:
        return 0
    start = 2 + more
    size = int.from_bytes(head[2:start]) if more else head[1]
    return start + size if head[start] == 0x30 or head[start : start + 3] in (b"\x02\x01\x00", b"\x02\x01\x01") else 0


def _base64_keys(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _RUN64.finditer(text):
        run, skip = m[0], 0
        for start in _WITHIN.finditer(run):
            at = start.start()
            if at < skip:
                continue
            if start[0] == "M":
                size = _size(_unbase64(run[at : at + 16]))
                if not size or size * 4 > (len(run) - at + 3) * 3:
                    continue
                kind, end = "der", private_key_end(_unbase64(run[at : at + (size + 2) // 3 * 4])[:size])
            elif start[0] == "b3BlbnNzaC1rZXkt":
                kind, end = "ssh", ssh_key_end(_unbase64(run[at:]))
            else:
                data = _unbase64(run[at:])
                inner = data.decode("latin-1")
                spans = list(_pem_blocks(inner))
                kind, end = "wrapped", len(data) if spans and spans[0][0] == 0 and not inner[spans[-1][1] :].strip() else 0
            if end:
                skip = min(len(run), at + -(-end * 4 // 3))
                while skip < len(run) and run[skip] == "=":
                    skip += 1
                yield kind, m.start() + at, m.start() + skip


def _hex_keys(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _RUN16.finditer(text):
        run, skip = m[0], 0
        for start in re.finditer("(?=30[0-9A-Fa-f]{46})", run):
            at = start.start()
            size = _size(_unhex(run[at : at + 24])) if at >= skip else 0
            if size and size * 2 <= len(run) - at and (end := private_key_end(_unhex(run[at : at + size * 2]))):
                skip = at + end * 2
                yield "der", m.start() + at, m.start() + skip


def _json(part: str) -> dict | None:
    try:
        x = json.loads(_unbase64(part))
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


def _tokens(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _DOTTED.finditer(text):
        parts, at, skip = m[0].split("."), m.start(), 0
        for k, head in enumerate(parts[:-2]):
            begin = next((x.start() for x in re.finditer("e[wy]", head) if re.match(rb'\{\s*"', _unbase64(head[x.start() : x.start() + 32]))), None) if at >= skip else None
            told = None if begin is None else _json(head[begin:])
            if told is not None and _json(parts[k + 1]) is not None:
                name, size = told.get("alg"), len(_unbase64(parts[k + 2]))
                if isinstance(name, str) and (size in _SIGNED.get(name, ()) or name in _RSA and size >= 128):
                    skip = at + len(head) + len(parts[k + 1]) + len(parts[k + 2]) + 2
                    yield "jwt", at + begin, skip
            at += len(head) + 1


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("pem", *x) for x in _pem_blocks(text)] if "PRIVATE KEY-----" in text else []
    found += [*_base64_keys(text), *_hex_keys(text), *_tokens(text)]
    found.sort(key=lambda x: (x[1], -x[2], KINDS.index(x[0])))
    out, reach = [], -1
    for x in found:
        if x[2] > reach:
            out.append(x)
            reach = x[2]
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = pc.fill_null(batch.column("text"), "")
        may = {k: pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for k, p in _MAY_HOLD.items()}
        plain, deep = may["assign"] | may["access"] | may["hex"], may["pem"] | may["run"] | may["jwt"]
        rows = []
        for k, text in enumerate(texts):
            said = text.as_py() if plain[k] or deep[k] else ""
            found = (plain_spans(said) if plain[k] else []) + (confirmed_spans(said) if deep[k] else [])
            rows.append(sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))
        flat, ends = [y for x in rows for y in x], [0]
        for x in rows:
            ends.append(ends[-1] + len(x))
        fields = [pa.array([x[0] for x in flat], pa.string()), *(pa.array([x[k] for x in flat], pa.int32()) for k in (1, 2))]
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "spans": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["kind", "start", "stop"]))})


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, spans (kind, start, stop: code points, stop exclusive) by start, then kind in the order of KINDS."""
    small_batches(docs.sparkSession)
    inner = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = inner.schema["id"].dataType.simpleString()
    return inner.mapInArrow(_scan, f"id {kind}, spans array<struct<kind: string, start: int, stop: int>>").withColumnRenamed("id", id_col)


def written(spans: Column) -> Column:
    """kind:start:stop of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """scan()'s rows as id_col, n_assign, n_access, n_hex, base_sha256 (of the plain spans as written()) and spans (all as written())."""
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in PLAIN]
    return scanned.select(F.col(f"`{id_col}`"), *counts, F.sha2(written(of(*PLAIN)), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
