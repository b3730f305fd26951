"""Signatures of quotes, beats and envelopes.

Envelopes (HMAC-SHA256) are sealed and opened in Catalyst expressions: a keyed hash is two of ``sha2``. Keccak-256 runs in NumPy over all messages
of an Arrow batch at once, a word of their states at a time. Curves need whole numbers of 256 bits, so recovery and verification
are Python for each signature, in batches; a signature is some milliseconds.

Defined results: a null message, signature or key has a null or false result, as has a malformed one; nothing is raised for a row.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keyed hashes


def _octets(x: Column, n: int) -> Column:
    """A whole number as n bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(x.cast("long")), 2 * n, "0"))


def _number(x: Column, at: int, n: int) -> Column:
    """The whole number in n bytes from at on (0-based)."""
    return F.conv(F.hex(F.substring(x, at + 1, n)), 16, 10).cast("decimal(20,0)")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """The keyed hash of a binary column, as binary."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256))


# Fixed values of the format: bytes of an envelope before its payload, and of its tag.
HEADER, TAG = 26, 32
# Fixed values too: bytes of one index record and of a heartbeat; a packed envelope has from 2 to MOST_FRAMES index records.
INDEX, BEAT, MOST_FRAMES = 56, 32, 20


def _version(n: Column) -> Column:
    packed = (n % INDEX == 0) & (n >= 2 * INDEX) & (n <= MOST_FRAMES * INDEX)
    return F.when(n.isin(INDEX, BEAT), 1).when(packed, 2)


def sealed(magic: bytes, key_id: int, key: bytes, sequence: Column, source_ms: Column, payload: Column) -> Column:
    """The envelope of a payload: magic, version, flags, key id, sequence, time and length (big-endian), payload, tag; null for one of no known length."""
    n = F.octet_length(payload)
    head = F.concat(F.lit(bytearray(magic)), _octets(_version(n), 1), F.lit(bytearray(1)), F.lit(bytearray(key_id.to_bytes(2, "big"))), _octets(sequence, 8), _octets(source_ms, 8), _octets(n, 2), payload)
    return F.concat(head, hmac_sha256(key, head))


def opened(frames: DataFrame, magic: bytes, keys: dict[int, bytes], frame: str = "frame") -> DataFrame:
    """Adds verdict (ok, or the first of length, magic, version, key, tag that is wrong), key_id, sequence, source_ms and payload; those are null unless it is ok."""
    f = F.col(frame)
    size = F.octet_length(f)
    n, key_id = _number(f, 24, 2).cast("int"), _number(f, 6, 2).cast("int")
    body = F.expr(f"substring(`{frame}`, 1, octet_length(`{frame}`) - {TAG})")
    tag = F.expr(f"substring(`{frame}`, octet_length(`{frame}`) - {TAG - 1}, {TAG})")
    good = F.lit(False)
    for i, key in keys.items():
        good = F.when(key_id == i, hmac_sha256(key, body) == tag).otherwise(good)
    verdict = (
        F.when(f.isNull() | (size < HEADER + BEAT + TAG) | (n + HEADER + TAG != size), "length")
        .when(F.substring(f, 1, 4) != F.lit(bytearray(magic)), "magic")
        .when(F.coalesce(_number(f, 4, 1).cast("int") != _version(n), F.lit(True)) | (F.hex(F.substring(f, 6, 1)) != "00"), "version")
        .when(~key_id.isin(*keys), "key")
        .when(good, "ok")
        .otherwise("tag")
    )
    out = frames.withColumn("verdict", verdict)
    ok = F.col("verdict") == "ok"
    payload = F.expr(f"substring(`{frame}`, {HEADER + 1}, octet_length(`{frame}`) - {HEADER + TAG})")
    return out.withColumns({"key_id": F.when(ok, key_id), "sequence": F.when(ok, _number(f, 8, 8)), "source_ms": F.when(ok, _number(f, 16, 8).cast("long")), "payload": F.when(ok, payload)})


# Keccak-256

MASK = (1 << 64) - 1


@lru_cache
def _schedule() -> tuple[list[int], list[list[int]]]:
    """Round constants from the permutation's shift register, and lane rotations from its triangular numbers."""
    bits, r = [], 1
    for _ in range(7 * 24):
        bits.append(r & 1)
        r = (r << 1) ^ (0x171 if r & 0x80 else 0)
    constants = [sum(bits[7 * i + j] << ((1 << j) - 1) for j in range(7)) for i in range(24)]
    turns, x, y = [[0] * 5 for _ in range(5)], 1, 0
    for t in range(24):
        turns[x][y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return constants, turns


def _turned(v: np.ndarray, n: int) -> np.ndarray:
    return v if not n else (v << np.uint64(n)) | (v >> np.uint64(64 - n))


def _permute(a: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    constants, turns = _schedule()
    for c in constants:
        parity = [a[x][0] ^ a[x][1] ^ a[x][2] ^ a[x][3] ^ a[x][4] for x in range(5)]
        mixed = [parity[x - 1] ^ _turned(parity[(x + 1) % 5], 1) for x in range(5)]
        b: list[list] = [[None] * 5 for _ in range(5)]
        for x in range(5):
            for y in range(5):
                b[y][(2 * x + 3 * y) % 5] = _turned(a[x][y] ^ mixed[x], turns[x][y])
        a = [[b[x][y] ^ (~b[(x + 1) % 5][y] & b[(x + 2) % 5][y]) for y in range(5)] for x in range(5)]
        a[0][0] = a[0][0] ^ np.uint64(c)
    return a


RATE = 136


def keccak_256(messages: list[bytes]) -> list[bytes]:
    """The hash of each message; those of as many blocks go through the permutation together."""
    out: list[bytes] = [b""] * len(messages)
    groups: dict[int, list[int]] = {}
    for i, m in enumerate(messages):
        groups.setdefault(len(m) // RATE + 1, []).append(i)
    for blocks, rows in groups.items():
        data = np.zeros((len(rows), blocks * RATE), np.uint8)
        for k, i in enumerate(rows):
            data[k, : len(messages[i])] = np.frombuffer(messages[i], np.uint8)
            data[k, len(messages[i])] ^= 0x01
            data[k, -1] ^= 0x80
        words = data.view("<u8").reshape(len(rows), blocks, RATE // 8)
        a = [[np.zeros(len(rows), np.uint64) for _ in range(5)] for _ in range(5)]
        for b in range(blocks):
            for w in range(RATE // 8):
                a[w % 5][w // 5] = a[w % 5][w // 5] ^ words[:, b, w]
            a = _permute(a)
        digest = np.stack([a[w][0] for w in range(4)], 1).astype("<u8")
        for k, i in enumerate(rows):
            out[i] = digest[k].tobytes()
    return out


def _hashed(values: pd.Series) -> pd.Series:
    there = values.notna()
    out = pd.Series([None] * len(values), index=values.index, dtype=object)
    out[there] = keccak_256([bytes(v) for v in values[there]])
    return out


def keccak(message: Column) -> Column:
    return F.pandas_udf(_hashed, "binary")(message)


# Fixed values of the format: what is signed, as EIP-712 writes types.
DOMAIN_TYPE = "EIP712Domain(string name,string version,uint256 chainId,address verifyingContract)"
BATCH_TYPE = "BatchQuote(bytes32 blobHash)"


def domain_separator(name: str, chain_id: int, contract: bytes, version: str = "1") -> bytes:
    if len(contract) != 20:
        raise ValueError("a contract's address has 20 bytes")
    parts = keccak_256([DOMAIN_TYPE.encode(), name.encode(), version.encode()])
    return keccak_256([b"".join(parts) + chain_id.to_bytes(32, "big") + contract.rjust(32, b"\0")])[0]


def batch_digests(blobs: list[bytes], domain: bytes) -> list[bytes]:
    """What is signed of each blob of quotes in a domain."""
    kind = keccak_256([BATCH_TYPE.encode()])[0]
    return keccak_256([b"\x19\x01" + domain + s for s in keccak_256([kind + h for h in keccak_256(blobs)])])


# secp256k1

P = 2**256 - 2**32 - 977
N = 0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFEBAAEDCE6AF48A03BBFD25E8CD0364141
G = (0x79BE667EF9DCBBAC55A06295CE870B07029BFCDB2DCE28D959F2815B16F81798, 0x483ADA7726A3C4655DA4FBFC0E1108A8FD17B448A68554199C47D08FFB10D4B8)

Point = tuple[int, int, int]


def _sum(a: Point, b: Point) -> Point:
    """Two points in Jacobian coordinates; z = 0 is the neutral one."""
    if not a[2] or not b[2]:
        return b if not a[2] else a
    z1, z2 = a[2] * a[2] % P, b[2] * b[2] % P
    u1, u2, s1, s2 = a[0] * z2 % P, b[0] * z1 % P, a[1] * z2 * b[2] % P, b[1] * z1 * a[2] % P
    h, r = (u2 - u1) % P, (s2 - s1) % P
    if not h:
        if r:
            return (0, 1, 0)
        y2 = a[1] * a[1] % P
        s, m = 4 * a[0] * y2 % P, 3 * a[0] * a[0] % P
        x = (m * m - 2 * s) % P
        return x, (m * (s - x) - 8 * y2 * y2) % P, 2 * a[1] * a[2] % P
    h2 = h * h % P
    h3, v = h * h2 % P, u1 * h2 % P
    x = (r * r - h3 - 2 * v) % P
    return x, (r * (v - x) - s1 * h3) % P, h * a[2] * b[2] % P


def times(k: int, point: tuple[int, int]) -> tuple[int, int] | None:
    out, at = (0, 1, 0), (*point, 1)
    while k:
        if k & 1:
            out = _sum(out, at)
        at, k = _sum(at, at), k >> 1
    if not out[2]:
        return None
    z = pow(out[2], -1, P)
    return out[0] * z * z % P, out[1] * z * z * z % P


def address(point: tuple[int, int]) -> bytes:
    return keccak_256([point[0].to_bytes(32, "big") + point[1].to_bytes(32, "big")])[0][12:]


def recovered(digest: bytes, signature: bytes) -> bytes | None:
    """The address that signed a digest: r, s and 27 or 28, 65 bytes; none if no point fits."""
    if len(signature) != 65 or signature[64] not in (27, 28):
        return None
    r, s = int.from_bytes(signature[:32], "big"), int.from_bytes(signature[32:64], "big")
    if not (0 < r < N and 0 < s < N):
        return None
    y2 = (pow(r, 3, P) + 7) % P
    y = pow(y2, (P + 1) // 4, P)
    if y * y % P != y2:
        return None
    y = P - y if y % 2 != signature[64] - 27 else y
    inverse, e = pow(r, -1, N), int.from_bytes(digest, "big")
    a, b = times(s * inverse % N, (r, y)), times(-e * inverse % N, G)
    both = a if b is None else _sum((*a, 1), (*b, 1))
    if len(both) == 3:
        if not both[2]:
            return None
        z = pow(both[2], -1, P)
        both = both[0] * z * z % P, both[1] * z * z * z % P
    return address(both)


def attested_by(blobs: DataFrame, name: str, chain_id: int, contract: bytes, blob: str = "blob", signature: str = "signature") -> DataFrame:
    """Adds attester: the address (binary) that signed a blob of quotes in a domain."""
    domain = domain_separator(name, chain_id, contract)

    @F.pandas_udf("binary")
    def found(b: pd.Series, s: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(b), index=b.index, dtype=object)
        there = b.notna() & s.notna()
        digests = batch_digests([bytes(x) for x in b[there]], domain)
        out[there] = pd.Series([recovered(d, bytes(x)) for d, x in zip(digests, s[there], strict=True)], index=out[there].index, dtype=object)
        return out

    return blobs.withColumn("attester", found(F.col(blob), F.col(signature)))


# ed25519

Q = 2**255 - 19
L = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, Q) % Q
ROOT = pow(2, (Q - 1) // 4, Q)

Extended = tuple[int, int, int, int]


def _plus(a: Extended, b: Extended) -> Extended:
    u, v, t, z = (a[1] - a[0]) * (b[1] - b[0]) % Q, (a[1] + a[0]) * (b[1] + b[0]) % Q, 2 * a[3] * b[3] * D % Q, 2 * a[2] * b[2] % Q
    e, f, g, h = v - u, z - t, z + t, v + u
    return e * f % Q, g * h % Q, f * g % Q, e * h % Q


def _often(k: int, point: Extended) -> Extended:
    out = (0, 1, 1, 0)
    while k:
        if k & 1:
            out = _plus(out, point)
        point, k = _plus(point, point), k >> 1
    return out


def _point(data: bytes) -> Extended | None:
    """A point from its 32 bytes; none unless they are its canonical ones."""
    y = int.from_bytes(data, "little")
    odd, y = y >> 255, y & ((1 << 255) - 1)
    if y >= Q:
        return None
    u, v = (y * y - 1) % Q, (D * y * y + 1) % Q
    x = u * pow(v, 3, Q) * pow(u * pow(v, 7, Q), (Q - 5) // 8, Q) % Q
    if (v * x * x - u) % Q:
        x = x * ROOT % Q
    if (v * x * x - u) % Q or (not x and odd):
        return None
    x = Q - x if x % 2 != odd else x
    return x, y, 1, x * y % Q


def _same(a: Extended, b: Extended) -> bool:
    return not (a[0] * b[2] - b[0] * a[2]) % Q and not (a[1] * b[2] - b[1] * a[2]) % Q


@lru_cache
def _base() -> Extended:
    return _point((4 * pow(5, -1, Q) % Q).to_bytes(32, "little"))


def verified(public: bytes, message: bytes, signature: bytes) -> bool:
    """Whether a signature is strictly valid: canonical numbers, no key or point of small order."""
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r, s = _point(public), _point(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= L or any(_same(_often(8, p), (0, 1, 1, 0)) for p in (a, r)):
        return False
    h = int.from_bytes(hashlib.sha512(signature[:32] + public + message).digest(), "little") % L
    return _same(_often(s, _base()), _plus(r, _often(h, a)))


def beats_verified(beats: DataFrame, keys: DataFrame, domain: bytes, frame: str = "frame", start: int = 16, end: int = 64) -> DataFrame:
    """Adds signed: whether bytes start to end of a beat, behind its domain, have the signature that follows them, by the key of its key_id.

    keys: key_id and public, any number of them. A beat without a key, or of another length, isn't signed.
    """
    k = keys.select(F.col("key_id").alias("_k"), F.col("public").alias("_public"))

    @F.pandas_udf("boolean")
    def good(f: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([x is not None and y is not None and len(x) == end + 64 and verified(bytes(y), domain + bytes(x[start:end]), bytes(x[end:])) for x, y in zip(f, p, strict=True)], index=f.index)

    return beats.join(k, F.col("key_id") == F.col("_k"), "left").withColumn("signed", good(F.col(frame), F.col("_public"))).drop("_k", "_public")
