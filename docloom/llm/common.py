"""What the operators share: shipping the package, the shared folder, text as arrays."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import unicodedata
import uuid
import zipfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Rows and bytes of one Arrow batch, so that a Python worker holds a few MB of texts at a time.
BATCH_ROWS, BATCH_BYTES = "1000", "16m"
#: Bytes (or code points) of text that are worked on as one numpy array.
CHUNK = 1 << 18


def prepare(spark: SparkSession) -> None:
    """Ship this package to the executors and bound the Arrow batches. Call it before any Python operator."""
    sc = spark.sparkContext
    if getattr(sc, "_docloom_shipped", False) is not True:
        folder = tempfile.mkdtemp(prefix="docloom-")  # read by the driver's own file server only
        atexit.register(shutil.rmtree, folder, True)
        path = os.path.join(folder, "docloom.zip")
        with zipfile.ZipFile(path, "w") as z:
            for d, _, names in os.walk(PACKAGE):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(d, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
        sc.addPyFile(path)
        sc._docloom_shipped = True
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder of the context. Where
    neither is set, a temporary one of this process in local mode; a cluster without a shared folder is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="docloom-shared-")
        atexit.register(shutil.rmtree, named, True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/docloom-{what}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: list[str], name: str) -> str:
    """name, or name with underscores in front, so that it clashes with no column (in any case of letters)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def crc_mod(column, n: int):
    """crc32 of the value as text, modulo n; -1 for null."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % F.lit(n), F.lit(-1).cast("long"))


def hash_below(column, share: float, seed: int):
    """True for about the given share of values, chosen by a seeded hash; all for a share of 1 or more."""
    if share >= 1:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


# --- code points ------------------------------------------------------------------------------

#: Letters that look like Latin ones. Cyrillic and Greek letters, then what they look like.
HOMOGLYPHS = dict(zip("абеорсухіјѕԁһкмтнвгпαοερτυνικχω", "abeopcyxijsdhkmthbrnaoeptuvikxw", strict=True))
#: Digits that stand for letters. Fixed values.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
#: Code points beyond this hold no letters of any script in use.
TABLE_SIZE = 0x32400


@lru_cache(maxsize=2)
def letter_table() -> np.ndarray:
    """Code point to lower-case letter, anything else to a space."""
    out = np.full(TABLE_SIZE + 1, 32, np.uint32)
    for i in range(TABLE_SIZE):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


@lru_cache(maxsize=2)
def fold_table() -> np.ndarray:
    """Code point to its plain form: lower case, no accents, homoglyphs and digits as the letters they
    stand for; anything that is no letter or digit to a space."""
    out = np.full(TABLE_SIZE + 1, 32, np.uint32)
    for i in range(TABLE_SIZE):
        c = chr(i)
        if c.isalnum():
            c = unicodedata.normalize("NFKD", c)[0].lower()[0]
            c = HOMOGLYPHS.get(c, LEET.get(c, c))
            out[i] = ord(c)
    for i in (*range(0x300, 0x370), 0x200B, 0x200C, 0x200D, 0xAD):  # combining marks and joiners vanish later
        out[i] = 0
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def through(table_: np.ndarray, points: np.ndarray) -> np.ndarray:
    return table_[np.minimum(points, TABLE_SIZE)]


def fold(text: str) -> str:
    """The text with fold_table applied, and combining marks removed."""
    out = through(fold_table(), code_points(text))
    if not out.all():
        out = out[out != 0]
    return out.tobytes().decode("utf-32-le", "surrogatepass")


# --- words ------------------------------------------------------------------------------------

#: The bytes that make words, after A-Z are lower-cased: digits, a-z, and every byte of a non-ASCII character.
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = True
_IS_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BREAK = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_P = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8; only A-Z are lower-cased."""
    return WORD.findall((text or "").encode("utf-8", "replace").translate(bytes(_LOWER)))


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A good mixing of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_word_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of data, and the byte places where each starts and ends."""
    raw = np.frombuffer(data, np.uint8)
    low = _LOWER[raw]
    is_word = np.zeros(len(low) + 2, np.int8)
    is_word[1:-1] = _IS_WORD[low]
    step = np.diff(is_word)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = _grown(max(len(low) + 1, CHUNK + (CHUNK >> 2)))
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    return mix(h), starts, ends


def word_chunks(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """Runs (first, past last, joined bytes) of texts of about CHUNK bytes; a longer text comes alone."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > CHUNK:
            yield first, i, b"\n".join(held)
            first, held, size = i, [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield first, len(texts), b"\n".join(held)


def pieces_of(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, piece) of a long text, cut between words."""
    at = 0
    while len(data) - at > CHUNK:
        m = _BREAK.search(data, at + CHUNK)
        if not m:
            break
        yield at, data[at : m.end()]
        at = m.end()
    yield at, data[at:]


def hashed_texts(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[bytes]]]:
    """For runs of texts: (first, past last, word hashes, the words' bounds by text, the texts' bytes)."""
    data = [(t or "").encode("utf-8", "replace") for t in texts]
    for first, last, joined in word_chunks(data):
        if last - first == 1:
            h = np.concatenate([hash_word_bytes(p)[0] for _, p in pieces_of(joined)])
            yield first, last, h, np.array([0, len(h)]), data[first:last]
        else:
            h, starts, _ = hash_word_bytes(joined)
            lengths = np.fromiter((len(d) + 1 for d in data[first:last]), np.int64, last - first)
            bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
            bounds[-1] = len(h)
            yield first, last, h, bounds, data[first:last]


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of width words that start at each place of h (fewer than h has)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
    return mix(out)
