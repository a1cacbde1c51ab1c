"""Accounting prototypes of encrypted comparison: Paillier sums and oblivious transfer.

They reproduce results and message sizes; nothing here is a claim of security.
Big integers stay inside Python functions and cross Spark as strings.
"""

from __future__ import annotations

import hashlib
import math
import random
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrine.functions.vectors import dot


def is_prime(n: int, rng: random.Random, rounds: int = 12) -> bool:
    """Miller-Rabin."""
    if n < 2:
        return False
    for p in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
        if n % p == 0:
            return n == p
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for _ in range(rounds):
        x = pow(rng.randrange(2, n - 1), odd, n)
        if x in (1, n - 1):
            continue
        if not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def prime(bits: int, rng: random.Random) -> int:
    while True:
        n = rng.getrandbits(bits) | 1 << (bits - 1) | 1
        if is_prime(n, rng):
            return n


@dataclass(frozen=True)
class PublicKey:
    n: int

    @property
    def square(self) -> int:
        return self.n * self.n

    def encrypt(self, m: int, rng: random.Random) -> int:
        while True:
            r = rng.randrange(1, self.n)
            if math.gcd(r, self.n) == 1:
                return (1 + m % self.n * self.n) * pow(r, self.n, self.square) % self.square

    def add(self, a: int, b: int) -> int:
        return a * b % self.square

    def add_plain(self, a: int, m: int) -> int:
        return a * (1 + m % self.n * self.n) % self.square

    def times(self, a: int, m: int) -> int:
        return pow(a, m, self.square)  # a negative power goes by the inverse, with a short exponent


@dataclass(frozen=True)
class KeyPair:
    public: PublicKey
    lam: int
    mu: int

    def decrypt(self, c: int) -> int:
        """Signed: values above n / 2 are negative."""
        n = self.public.n
        m = (pow(c, self.lam, self.public.square) - 1) // n * self.mu % n
        return m - n if m > n // 2 else m


def key_pair(bits: int, seed: int) -> KeyPair:
    """Paillier with generator n + 1."""
    rng = random.Random(seed)
    while True:
        p, q = prime(bits // 2, rng), prime(bits // 2, rng)
        if p != q and math.gcd(p * q, (p - 1) * (q - 1)) == 1:
            break
    lam = math.lcm(p - 1, q - 1)
    return KeyPair(PublicKey(p * q), lam, pow(lam, -1, p * q))


def encrypt_query(public: PublicKey, q: list[int], rng: random.Random) -> tuple[dict[int, int], int]:
    """The encrypted dimensions of an integer vector, zeros left out, and their bytes."""
    out = {i: public.encrypt(int(x), rng) for i, x in enumerate(q) if x}
    return out, sum(integer_bytes(c) for c in out.values())


def encrypted_scores(pairs: DataFrame, public: PublicKey, scale_square: int, seed: int) -> DataFrame:
    """(query_id, doc_idx, cipher, request_bytes): the encryption of scale^2 - sum q_i d_i; pairs(query_id, doc_idx, q, d) of integer vectors.

    A query is encrypted once, for all its candidates, whose number is fixed.
    """

    def run(f):
        rng = random.Random(f"{seed}:{f['query_id'].iloc[0]}")
        sent, size = encrypt_query(public, f["q"].iloc[0], rng)
        out = []
        for d in f["d"]:
            c = public.encrypt(0, rng)
            for i, a in sent.items():
                if d[i]:
                    c = public.add(c, public.times(a, -int(d[i])))
            out.append(str(public.add_plain(c, scale_square)))
        return pd.DataFrame({"query_id": f["query_id"], "doc_idx": f["doc_idx"], "cipher": out, "request_bytes": size})

    return pairs.select("query_id", "doc_idx", "q", "d").groupBy("query_id").applyInPandas(run, "query_id long, doc_idx long, cipher string, request_bytes long")


def decrypt_scores(ciphers: DataFrame, keys: KeyPair, scale_square: int) -> DataFrame:
    """(query_id, doc_idx, distance): decrypted, over scale^2."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"query_id": f.query_id, "doc_idx": f.doc_idx, "distance": [keys.decrypt(int(c)) / scale_square for c in f.cipher]})

    return ciphers.mapInPandas(run, "query_id long, doc_idx long, distance double")


def plain_integer_ranking(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_idx, score): what the encrypted ranking decrypts to: the k largest integer inner products, ties by index."""
    s = F.aggregate(F.zip_with("q", "d", lambda a, b: a * b), F.lit(0).cast("long"), lambda x, y: x + y)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_idx")
    return pairs.select("query_id", "doc_idx", s.alias("score")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def key_stream(label: bytes, size: int) -> bytes:
    """SHA-256 in counter mode."""
    out, n = b"", 0
    while len(out) < size:
        out += hashlib.sha256(label + n.to_bytes(8, "big")).digest()
        n += 1
    return out[:size]


def xor(a: bytes, b: bytes) -> bytes:
    return bytes(x ^ y for x, y in zip(a, b))


def integer_bytes(n: int) -> int:
    return max(1, (n.bit_length() + 7) // 8)


@dataclass(frozen=True)
class Transfer:
    """A Diffie-Hellman group for k-of-n oblivious transfer."""

    p: int
    g: int = 2

    def run(self, payloads: list[bytes], wanted: set[int], rng: random.Random) -> tuple[dict[int, bytes], int]:
        """The wanted payloads, and the bytes sent both ways."""
        a = rng.randrange(2, self.p - 1)
        big_a = pow(self.g, a, self.p)
        inverse = pow(big_a, -1, self.p)
        got, sent = {}, integer_bytes(big_a)
        for i, load in enumerate(payloads):
            b = rng.randrange(2, self.p - 1)
            big_b = pow(self.g, b, self.p) * (big_a if i in wanted else 1) % self.p
            keys = [pow(x, a, self.p) for x in (big_b, big_b * inverse % self.p)]
            cipher = [xor(load, key_stream(f"{i}:{side}:{key}".encode(), len(load))) if side else b"" for side, key in enumerate(keys)]
            sent += integer_bytes(big_b) + len(load)
            if i in wanted:
                key = pow(big_a, b, self.p)
                got[i] = xor(cipher[1], key_stream(f"{i}:1:{key}".encode(), len(load)))
        return got, sent


def oblivious_transfer(payloads: DataFrame, bits: int, seed: int) -> DataFrame:
    """(query_id, received, payload_bytes, bytes_sent): runs the transfer of each query's payloads (query_id, position, payload, wanted)."""
    group = Transfer(prime(bits, random.Random(seed)))

    def run(key, f):
        f = f.sort_values("position")
        got, sent = group.run([s.encode() for s in f.payload], {i for i, w in enumerate(f.wanted) if w}, random.Random(f"{seed}:{key[0]}"))
        ok = all(got[i].decode() == f.payload.iloc[i] for i in got)
        return pd.DataFrame({"query_id": [key[0]], "received": [len(got) if ok else -1], "payload_bytes": [sum(len(s.encode()) for s in f.payload)], "bytes_sent": [sent]})

    return payloads.groupBy("query_id").applyInPandas(run, "query_id long, received int, payload_bytes long, bytes_sent long")


def direct_bytes(payloads: DataFrame) -> DataFrame:
    """(query_id, bytes): what is sent when the wanted payloads are asked for by their positions."""
    return payloads.filter("wanted").groupBy("query_id").agg(F.sum(F.octet_length("payload")).alias("bytes"))


# --- a lattice scheme, by what it computes and sends ---------------------------

# The parameters of the scheme.
LATTICE_DEGREE = 8192
LATTICE_BITS = (60, 40, 40, 60)
LATTICE_SCALE = 1 << 40
LATTICE_TOLERANCE = 0.25


@dataclass(frozen=True)
class Lattice:
    """Sizes and rounding of approximate arithmetic on packed vectors; a vector must fit the degree / 2 slots.

    There is no cipher here: values are rounded to the scale as an encoding
    would round them, and a message has the bytes of two polynomials.
    """

    degree: int = LATTICE_DEGREE
    bits: tuple[int, ...] = LATTICE_BITS
    scale: int = LATTICE_SCALE

    def check(self, slots: int) -> None:
        if slots > self.degree // 2:
            raise ValueError(f"{slots} values don't fit {self.degree // 2} slots")

    @property
    def message_bytes(self) -> int:
        """Of a fresh cipher: two polynomials modulo all but the last prime."""
        return 2 * self.degree * sum(self.bits[:-1]) // 8

    @property
    def answer_bytes(self) -> int:
        """Of a product: one prime less."""
        return 2 * self.degree * sum(self.bits[:-2]) // 8

    def encoded(self, v: Column) -> Column:
        return F.transform(v, lambda x: F.rint(x.cast("double") * float(self.scale)) / float(self.scale))

    def scores(self, pairs: DataFrame, dim: int) -> DataFrame:
        """(query_id, doc_idx, score): inner products of encoded queries with plain vectors; pairs(query_id, doc_idx, qv, v)."""
        self.check(dim)
        return pairs.select("query_id", "doc_idx", dot(self.encoded(F.col("qv")), F.col("v")).alias("score"))


def rounded_integers(value: Column, tolerance: float = LATTICE_TOLERANCE) -> Column:
    """The nearest integer of a decrypted value; one that is further off than the tolerance is an error."""
    near = F.rint(value)
    return F.when(F.abs(value - near) <= tolerance, near.cast("long")).otherwise(F.raise_error(F.lit("a decrypted value isn't near an integer")).cast("long"))


def payload_json(*columns: Column) -> Column:
    """Canonical JSON of a document: give the columns in the order of their names."""
    return F.to_json(F.struct(*columns))
