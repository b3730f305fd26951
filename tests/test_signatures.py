"""Published vectors of the hashes and curves, and what the Spark forms make of good, forged and malformed rows."""

import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from tickloom.sources import signatures as S


def test_keccak():
    rng = random.Random(1)
    assert S.keccak_256([b"", b"abc"]) == [bytes.fromhex("c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"), bytes.fromhex("4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45")]
    many = [rng.randbytes(n) for n in (0, 1, 134, 135, 136, 137, 271, 272, 1000)]
    assert S.keccak_256(many) == [S.keccak_256([m])[0] for m in many] and len(set(S.keccak_256(many))) == len(many)
    # the same permutation under the other padding is SHA3-256
    a = S._permute([[S.np.zeros(1, S.np.uint64) for _ in range(5)] for _ in range(5)])
    assert int(a[0][0][0]) == 0xF1258F7940E1DDE7 and int(a[1][0][0]) == 0x84D5CCF933C0478A


def signed(key, digest, k):
    x, y = S.times(k, S.G)
    r = x % S.N
    s = pow(k, -1, S.N) * (int.from_bytes(digest, "big") + r * key) % S.N
    return r.to_bytes(32, "big") + s.to_bytes(32, "big") + bytes([27 + y % 2])


COW = int.from_bytes(S.keccak_256([b"cow"])[0], "big")


def test_addresses_and_recovery(spark):
    assert S.address(S.times(COW, S.G)).hex() == "cd2a3d9f938e13cd947ec05abc7fe734df8dd826"
    contract = bytes(range(20))
    domain = S.domain_separator("quotes", 56, contract)
    assert domain != S.domain_separator("quotes", 1, contract) != S.domain_separator("quotes", 56, bytes(20))
    blobs = [b"\x01" + bytes([i]) * (7 + 22 * (i + 1)) for i in range(6)]
    rows = [(i, b, signed(COW, S.batch_digests([b], domain)[0], 12345 + i)) for i, b in enumerate(blobs)]
    forged = [(10, blobs[0], rows[1][2]), (11, blobs[0], rows[0][2][:64] + b"\x1d"), (12, None, rows[0][2]), (13, blobs[0], None), (14, blobs[0], b"short"), (15, blobs[0], bytes(65))]
    got = {r["i"]: r["attester"] for r in S.attested_by(spark.createDataFrame([*rows, *forged], "i int, blob binary, signature binary"), "quotes", 56, contract).collect()}
    own = S.address(S.times(COW, S.G))
    assert all(bytes(got[i]) == own for i in range(6)) and bytes(got[10]) != own and [got[i] for i in (11, 12, 13, 14, 15)] == [None] * 5
    with pytest.raises(ValueError):
        S.domain_separator("quotes", 1, b"x")


RFC = [
    ("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
]


def test_ed25519():
    for public, message, signature in ((bytes.fromhex(x) for x in v) for v in RFC):
        assert S.verified(public, message, signature)
        assert not S.verified(public, message + b"x", signature)
        s = int.from_bytes(signature[32:], "little") + S.L
        assert not S.verified(public, message, signature[:32] + s.to_bytes(32, "little"))
        assert not S.verified(public, message, bytes([signature[0] ^ 1]) + signature[1:]) and not S.verified(public[:-1], message, signature)
    small = (1).to_bytes(32, "little")
    assert not S.verified(small, b"", small + bytes(32))


def ed_sign(seed, message):
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | (1 << 254)

    def packed(p):
        z = pow(p[2], -1, S.Q)
        return ((p[1] * z % S.Q) | ((p[0] * z % S.Q) & 1) << 255).to_bytes(32, "little")

    public = packed(S._often(a, S._base()))
    r = int.from_bytes(hashlib.sha512(h[32:] + message).digest(), "little") % S.L
    head = packed(S._often(r, S._base()))
    k = int.from_bytes(hashlib.sha512(head + public + message).digest(), "little") % S.L
    return public, head + ((r + k * a) % S.L).to_bytes(32, "little")


def test_beats(spark):
    rng, domain = random.Random(3), b"beats/v1\0"
    rows, keys = [], {}
    for i in range(6):
        head, body = rng.randbytes(16), rng.randbytes(48)
        keys[i % 2], tail = ed_sign(bytes([i % 2]) * 32, domain + body)
        rows.append((i, i % 2, head + body + tail))
    rows += [(10, 1, rows[0][2]), (11, 9, rows[0][2]), (12, 0, rows[0][2][:-1]), (13, 0, None), (14, 0, rows[0][2][:20] + b"x" + rows[0][2][21:])]
    k = spark.createDataFrame(list(keys.items()), "key_id int, public binary")
    got = {r["i"]: r["signed"] for r in S.beats_verified(spark.createDataFrame(rows, "i int, key_id int, frame binary"), k, domain).collect()}
    assert [got[i] for i in range(6)] == [True] * 6 and not any(got[i] for i in (10, 11, 12, 13, 14))


def test_envelopes(spark):
    keys = {7: b"k" * 32, 258: bytes(range(100))}
    for key in keys.values():
        got = spark.createDataFrame([(b"",), (b"abc",), (bytes(range(256)),)], "m binary").select("m", S.hmac_sha256(key, F.col("m")).alias("h")).collect()
        assert all(bytes(r["h"]) == hmac.new(key, bytes(r["m"]), hashlib.sha256).digest() for r in got)
    rows = spark.createDataFrame([(i, bytes([i]) * n) for i, n in enumerate((32, 56, 112, 1120))] + [(9, b"odd"), (10, bytes(1176))], "i int, body binary")
    frames = rows.withColumn("frame", S.sealed(b"ENV1", 258, keys[258], F.col("i") + 5, F.lit(1_700_000_000_123), F.col("body")))
    back = {r["i"]: r for r in S.opened(frames, b"ENV1", keys).collect()}
    assert all((back[i]["verdict"], back[i]["key_id"], int(back[i]["sequence"]), back[i]["source_ms"], bytes(back[i]["payload"])) == ("ok", 258, i + 5, 1_700_000_000_123, bytes(back[i]["body"])) for i in range(4))
    assert back[9]["verdict"] == back[10]["verdict"] == "length" and back[9]["frame"] is None
    f = bytes(back[1]["frame"])
    bad = {"magic": b"X" + f[1:], "version": f[:4] + b"\x02" + f[5:], "key": f[:7] + b"\x09" + f[8:], "tag": f[:40] + b"!" + f[41:], "length": f[:-1]}
    got = {r["name"]: (r["verdict"], r["payload"]) for r in S.opened(spark.createDataFrame(list(bad.items()), "name string, frame binary"), b"ENV1", keys).collect()}
    assert got == {name: (name, None) for name in bad}
