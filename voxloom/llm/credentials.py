"""Secrets in texts: fixed patterns, and encoded structures that decode and parse.

Base spans follow fixed patterns (assignments to telling names, access key ids, runs of hex
digits) and always stay.  Beyond them, candidates are runs of base64 (either alphabet, also
broken into lines as in a PEM block, or with written line ends) and of hex digits.  A candidate
is reported only if its bytes have the structure of a secret, whatever stands around it:

* ``key``: a private key.  DER (PKCS#1, SEC 1, DSA, PKCS#8 plain or encrypted, PKCS#12), every
  nested length agreeing with what holds it; the ``openssh-key-v1`` container, field by field; an
  OpenPGP secret key packet; or a PEM block labelled as a private key with encrypted content of
  whole cipher blocks.
* ``token``: a signed or encrypted token of three or five parts, whose header is a JSON object
  naming a known algorithm, whose claims are a JSON object, and whose signature has the length
  that the algorithm prescribes.  Unsigned tokens and public keys are not secrets.

A structure found inside a base span is reported next to it.  A key tells its length, or
that of its fields, in its first bytes: no format here goes on beyond 64 KiB (``MOST``), so no
candidate is decoded further.  A PEM block that is base64 as a whole is a key too.

Offsets count code points, ends are exclusive.  Null texts are empty and have no span; repeated
rows are judged alike; an empty table gives an empty table; only doc_id and text are read,
whatever the other columns are called.  The work is one map over the documents.
"""

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from voxloom.llm.common import raw, result, text_batches

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "key", "token")
ORDER = {k: i for i, k in enumerate(KINDS)}
Span = tuple[int, int, str]

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

# Where base64 of DER (30 and a length), of an ssh container, of a secret key packet (94, 95 or
# c5 and a length) or of a PEM block may start.
ENCODED = re.compile(r"M(?:I[G-L]|[C-H][A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{5}|b3BlbnNzaC1rZXktdjEA|(?:l[B-Q]|x[R-Za-d])[A-Za-z0-9+/_-]{6}|LS0tLS1CRUdJTi")
DIGITS = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{48,}")
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]*){2,4}")
PIECE = re.compile(r"[A-Za-z0-9+/_-]+")
BREAK = re.compile(r"(?:\r?\n|\\r\\n|\\n)[ \t]*")
FILLING = re.compile(r"={0,2}")
STANDARD = str.maketrans("-_", "+/")

# Object identifiers (DER content) and signature lengths in bytes.
KEY_ALGORITHMS = {
    bytes.fromhex(x) for x in (
        "2a864886f70d010101", "2a864886f70d01010a", "2a8648ce3d0201", "2a8648ce380401", "2a864886f70d010301",
        "2b656e", "2b656f", "2b6570", "2b6571",
    )
}  # rsa, rsa-pss, ec, dsa, dh, x25519, x448, ed25519, ed448
ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))  # pkcs-5, pkcs-12 schemes
PKCS7_DATA = (bytes.fromhex("2a864886f70d010701"), bytes.fromhex("2a864886f70d010702"))
SIGNATURES = {
    "HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132,
    "RS256": None, "RS384": None, "RS512": None, "PS256": None, "PS384": None, "PS512": None, "EdDSA": (64, 114),
}
LEAST_RSA = 128  # bytes of a signature without a fixed length
MOST = 1 << 16  # bytes of a key container
INTEGER, BITS, OCTETS, IDENTIFIER, SEQUENCE, SET = 0x02, 0x03, 0x04, 0x06, 0x30, 0x31


def base_spans(text: str) -> list[Span]:
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], ORDER[s[2]]))


# --- structures in bytes: each function returns how many bytes belong to it, 0 if it is none


def der(data: bytes, at: int = 0, end: int | None = None) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the DER value at a place; None if malformed."""
    end = len(data) if end is None else end
    if at + 2 > end:
        return None
    tag, size, start = data[at], data[at + 1], at + 2
    if size >= 0x80:
        many = size & 0x7F
        if not 1 <= many <= 2 or start + many > end:
            return None
        size, start = int.from_bytes(data[start : start + many], "big"), start + many
        if size < 0x80 or many == 2 and size < 0x100:
            return None  # longer than it need be
    return (tag, start, start + size) if start + size <= end else None


def children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill the content exactly; None if they do not."""
    out = []
    while start < end:
        value = der(data, start, end)
        if value is None:
            return None
        out.append(value)
        start = value[2]
    return out


def well_formed(data: bytes, start: int, end: int) -> bool:
    """Whether every constructed value inside is filled exactly, at every depth."""
    open_values = [(start, end)]
    while open_values:
        parts = children(data, *open_values.pop())
        if parts is None:
            return False
        open_values += [(s, e) for tag, s, e in parts if tag & 0x20]
    return True


def der_key(data: bytes) -> int:
    """A DER private key at the start."""
    whole = der(data)
    if whole is None or whole[0] != SEQUENCE:
        return 0
    _, start, end = whole
    parts = children(data, start, end)
    if not parts or not well_formed(data, start, end):
        return 0
    tags, content = [t for t, _, _ in parts], [data[s:e] for _, s, e in parts]
    if tags[0] == INTEGER and len(content[0]) == 1:
        version, numbers = content[0][0], all(t == INTEGER and c for t, c in zip(tags, content))
        if numbers and (version == 0 and len(parts) in (6, 9) or version == 1 and len(parts) == 9):
            return end if min(map(len, content[1:3])) >= 1 and len(content[1]) >= 32 else 0  # dsa, rsa
        if version <= 1 and len(parts) >= 3 and tags[1:3] == [SEQUENCE, OCTETS]:
            inner = children(data, parts[1][1], parts[1][2])
            named = inner and inner[0][0] == IDENTIFIER and data[inner[0][1] : inner[0][2]] in KEY_ALGORITHMS
            return end if named and content[2] else 0  # pkcs-8
        if version == 1 and tags[1] == OCTETS and 14 <= len(content[1]) <= 72 and all(t in (0xA0, 0xA1) for t in tags[2:]):
            return end if len(parts) > 2 or end - start > 24 else 0  # sec 1
        if version == 3 and len(parts) in (2, 3) and tags[1] == SEQUENCE:
            inner = children(data, parts[1][1], parts[1][2])
            named = inner and inner[0][0] == IDENTIFIER and data[inner[0][1] : inner[0][2]] in PKCS7_DATA
            return end if named else 0  # pkcs-12
    if tags == [SEQUENCE, OCTETS] and content[1]:
        inner = children(data, parts[0][1], parts[0][2])
        scheme = data[inner[0][1] : inner[0][2]] if inner and inner[0][0] == IDENTIFIER else b""
        return end if scheme.startswith(ENCRYPTION) and len(content[1]) % 8 == 0 else 0  # encrypted pkcs-8
    return 0


SSH_MAGIC = b"openssh-key-v1\0"


def ssh_key(data: bytes) -> int:
    """An openssh-key-v1 container: cipher, kdf, its options, number of keys, public keys, private part."""
    if not data.startswith(SSH_MAGIC):
        return 0
    at = len(SSH_MAGIC)

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    cipher, kdf, options = field(), field(), field()
    if not cipher or not kdf or options is None or at + 4 > len(data):
        return 0
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 64 or any(not field() for _ in range(keys)):
        return 0
    private = field()
    if not private or len(private) % 8 or cipher == b"none" and private[:4] != private[4:8]:
        return 0
    return at


def pgp_packet(head: bytes) -> tuple[int, int] | None:
    """Start and end of the content of a version 4 secret key packet."""
    first, start, size = head[0], 2, head[1]
    if first == 0x95:  # the old format with two length bytes
        start, size = 3, int.from_bytes(head[1:3], "big")
    elif first == 0xC5 and size >= 192:
        start, size = 3, (size - 192 << 8) + head[2] + 192 if size < 224 else 0
    elif first not in (0x94, 0xC5):
        return None
    return (start, start + size) if size >= 20 and head[start] == 4 else None


def pgp_key(data: bytes) -> int:
    """An OpenPGP secret key packet (tag 5): length, version, time, algorithm, public numbers."""
    if len(data) < 8:
        return 0
    packet = pgp_packet(data)
    if packet is None or packet[1] > len(data):
        return 0
    start, end = packet
    algorithm, at = data[start + 5], start + 6
    numbers = {1: 2, 2: 2, 3: 2, 16: 3, 17: 4}.get(algorithm)
    if algorithm in (18, 19, 22):
        at, numbers = at + 1 + data[at], 1  # the curve, then the point
    if not numbers:
        return 0
    for _ in range(numbers):
        bits = int.from_bytes(data[at : at + 2], "big")
        width = (bits + 7) // 8
        if not bits or at + 2 + width >= end or data[at + 2].bit_length() != (bits - 1) % 8 + 1:
            return 0
        at += 2 + width
    return end


def key_size(data: bytes) -> int:
    """How many bytes at the start are a private key; 0 if they are none."""
    if data[:1] == b"\x30":
        return der_key(data)
    if data.startswith(b"-----BEGIN"):  # a PEM block encoded once more
        blocks = armoured_keys(data.decode("latin-1"))
        return blocks[0][1] if blocks and not blocks[0][0] else 0
    return ssh_key(data) if data.startswith(SSH_MAGIC) else pgp_key(data)


def told_size(head: bytes) -> int:
    """How many bytes a structure with these first six has at most; 0 if they start none."""
    if head[0] == 0x30:
        size, start = head[1], 2
        if size & 0x80:
            start += size & 0x7F
            size = int.from_bytes(head[2:start], "big") if start <= 4 else 0
        return start + size if size >= 38 and head[start] in (INTEGER, SEQUENCE) else 0
    if head in (SSH_MAGIC[:6], b"-----B"):
        return MOST
    packet = pgp_packet(head)
    return packet[1] if packet else 0


# --- candidates in texts


def decoded(digits: str) -> bytes:
    """Bytes of base64 in either alphabet, without its filling; an odd digit at the end is left."""
    digits = digits.translate(STANDARD)
    if len(digits) % 4 == 1:
        digits = digits[:-1]
    return base64.b64decode(digits + "=" * (-len(digits) % 4))


def base64_from(text: str, at: int, most: int) -> tuple[str, list[tuple[int, int]]]:
    """At most ``most`` base64 digits from a place on, across line ends, and where their pieces stand."""
    parts, places, have = [], [], 0
    while have < most:
        piece = PIECE.match(text, at, min(len(text), at + most - have))
        if not piece:
            break
        parts.append(piece[0])
        places.append((at, have))
        have, at = have + len(piece[0]), piece.end()
        gap = BREAK.match(text, at)
        if not gap:
            break
        at = gap.end()
    return "".join(parts), places


def encoded_keys(text: str) -> list[Span]:
    """Private keys in base64, wherever one starts within a run."""
    spans, at = [], 0
    while found := ENCODED.search(text, at):
        at = found.start()
        told, size = told_size(decoded(text[at : at + 8])), 0
        if told:
            digits, places = base64_from(text, at, -(-told * 4 // 3))
            size = key_size(decoded(digits)) if len(digits) >= 54 else 0
        if size:
            last = -(-size * 4 // 3)
            start, before = next(p for p in reversed(places) if p[1] < last)
            end = FILLING.match(text, start + last - before).end()
            spans.append((at, end, "key"))
            at = end
        else:
            at += 1
    return spans


def hex_keys(text: str) -> list[Span]:
    """Private keys in hex digits, at the start of a run."""
    spans = []
    for m in DIGITS.finditer(text):
        if m[0][:2] in ("30", "6f", "6F", "94", "95", "c5", "C5"):
            size = key_size(bytes.fromhex(m[0][: len(m[0]) // 2 * 2]))
            if size:
                spans.append((m.start(), m.start() + 2 * size, "key"))
    return spans


def armoured_keys(text: str) -> list[Span]:
    """PEM blocks labelled as private keys whose content is enciphered or a key."""
    spans, at = [], 0
    while found := ARMOUR.search(text, at):
        at, foot = found.end(), f"-----END {found[1]}-----"
        stop = text.find("-----", at)
        if stop < 0 or not text.startswith(foot, stop):
            continue
        body = BREAK.sub("\n", text[at:stop]).strip()
        head, _, rest = body.rpartition("\n\n")
        lines = [x for x in rest.split() if not (x.startswith("=") and len(x) == 5)]  # not the checksum
        digits = "".join(lines).rstrip("=")
        if not PIECE.fullmatch(digits) or len(digits) % 4 == 1:
            continue
        data = decoded(digits)
        enciphered = "ENCRYPTED" in head and "DEK-Info:" in head and data and len(data) % 8 == 0
        if enciphered or key_size(data):
            spans.append((found.start(), stop + len(foot), "key"))
            at = stop + len(foot)
    return spans


def json_object(part: str) -> dict | None:
    if len(part) % 4 == 1:
        return None
    try:
        value = json.loads(decoded(part))
    except (ValueError, RecursionError, binascii.Error):
        return None
    return value if isinstance(value, dict) else None


def token_parts(parts: list[str]) -> int:
    """How many of the dot-separated parts are a signed (3) or encrypted (5) token; 0 if none."""
    header = json_object(parts[0])
    if not header or not isinstance(header.get("alg"), str):
        return 0
    if isinstance(header.get("enc"), str):
        whole = len(parts) >= 5 and all(parts[2:5]) and all(len(p) % 4 != 1 for p in parts[1:5])
        return 5 if whole else 0
    if header["alg"] not in SIGNATURES or len(parts[2]) % 4 == 1:
        return 0
    size, want = len(parts[2]) * 3 // 4, SIGNATURES[header["alg"]]
    fits = size >= LEAST_RSA if want is None else size in want if isinstance(want, tuple) else size == want
    return 3 if fits and json_object(parts[1]) is not None else 0


def tokens(text: str) -> list[Span]:
    spans, at = [], 0
    while found := TOKEN.search(text, at):
        at, parts = found.start(), found[0].split(".")
        many = token_parts(parts)
        if many:
            end = at + len(".".join(parts[:many]))
            spans.append((at, end, "token"))
            at = end
        else:
            at += len(parts[0])  # a header may follow the dot
    return spans


def structures(text: str) -> list[Span]:
    """Confirmed structures; a key inside its PEM block is part of it."""
    blocks = armoured_keys(text) if "PRIVATE KEY" in text else []
    inside = lambda s: any(b[0] <= s[0] and s[1] <= b[1] for b in blocks)
    return [*blocks, *[s for s in encoded_keys(text) + hex_keys(text) if not inside(s)], *tokens(text)]


def spans_of(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, by start and kind."""
    base = base_spans(text)
    more = structures(text)
    return base, sorted(base + more, key=lambda s: (s[0], ORDER[s[2]])) if more else base


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans of every document, and how many
    structures were confirmed (n_key, n_token)."""

    def find(arrow):
        for batch, texts in text_batches(arrow):
            found = [spans_of(t.decode("utf-8", "replace")) for t in texts]
            counts = {f"n_{k}": pa.array([sum(s[2] == k for s in every) for _, every in found], pa.int64()) for k in KINDS}
            digests = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]
            yield result(
                batch, ["doc_id"], **counts, base_sha256=pa.array(digests, pa.string()),
                spans=pa.array([written(every) for _, every in found], pa.string()),
            )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", raw("text").alias("text")).mapInArrow(
        find, f"doc_id long, {counts}, base_sha256 string, spans string"
    )
