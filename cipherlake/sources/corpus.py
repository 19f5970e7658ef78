"""File sources: a pruned directory listing, any table of texts, one uploaded file, and the mock corpus."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.functions.text import decode_manifest, decode_source, extension
from cipherlake.functions.urls import basename
from cipherlake.rules.tables import LANGUAGE_EXTENSIONS, MANIFEST_EXTENSIONS, MANIFEST_NAMES, MANIFEST_SKIP_DIRS, SOURCE_SKIP_DIRS
from cipherlake.shipping import ship_package
from cipherlake.sources.tree import path_order, read_bytes, source_tree, walk_order, without_directories


#: Suffixes of registered languages.
EXTRA_EXTENSIONS: dict[str, tuple[str, ...]] = {}


def directories() -> Column:
    """The directory names of rel_path."""
    parts = F.split("rel_path", "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def not_skipped(skip: tuple[str, ...]) -> Column:
    """No directory below the root is in the skip list or hidden; hidden files are fine."""
    return ~F.exists(directories(), lambda d: d.isin(*skip) | d.startswith("."))


def file_name() -> Column:
    return F.element_at(F.split("rel_path", "/"), -1)


def source_language() -> Column:
    """The language of a source file by its suffix in any case; `.ts` and `.tsx` (lower case) are TypeScript."""
    ext, chain = extension(file_name()), F.when(F.col("rel_path").rlike(r"\.tsx?$"), "typescript")
    for language, extensions in [*LANGUAGE_EXTENSIONS.items(), *EXTRA_EXTENSIONS.items()]:
        chain = chain.when(ext.isin(*extensions), language)
    return chain


def is_manifest() -> Column:
    return file_name().isin(*MANIFEST_NAMES) | extension(file_name()).isin(*MANIFEST_EXTENSIONS)


def list_directory(spark: SparkSession, root: str, subtrees: int = 64) -> DataFrame:
    """(file_path, rel_path) of the files under a directory that driver and executors can both read (see `source_tree`).

    Directories that both scans skip, and hidden ones, are pruned before descent. Raises NotADirectoryError if there is no
    such directory.
    """
    skip = sorted(set(SOURCE_SKIP_DIRS) & set(MANIFEST_SKIP_DIRS))
    return source_tree(spark, root, subtrees).where(without_directories(skip)).select("file_path", "rel_path")


def list_by_extension(spark: SparkSession, root: str, *extensions: str) -> DataFrame:
    """Paths (file_path, rel_path) of the files with one of the suffixes (with a dot, any case), as one language's scan
    lists them: by whole path for one suffix, directory by directory for several."""
    wanted = [e.lower() if e.startswith(".") else f".{e.lower()}" for e in extensions]
    found = source_tree(spark, root).where(without_directories(SOURCE_SKIP_DIRS)).where(F.col("extension").isin(wanted))
    return found.orderBy(*(path_order() if len(wanted) == 1 else walk_order())).select("file_path", "rel_path")


def read_files(paths: DataFrame) -> DataFrame:
    """Adds `content`; unreadable files have empty content. File names that Spark's readers hide are read too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # files may be large: one at a time
                one = batch.slice(k, 1)
                content = pa.array([read_bytes(one.column(0)[0].as_py())], type=pa.binary())
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), content], names=["file_path", "rel_path", "content"])

    ship_package(paths.sparkSession)
    return paths.select("file_path", "rel_path").mapInArrow(run, "file_path string, rel_path string, content binary")


def directory(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(sources, manifests) of a directory; only files that a scan reads are opened, dealt by name to many tasks."""
    dealt = list_directory(spark, root).repartition(max(16, 4 * spark.sparkContext.defaultParallelism), "file_path")
    wanted_sources = dealt.where(source_language().isNotNull() & not_skipped(SOURCE_SKIP_DIRS))
    wanted_manifests = dealt.where(is_manifest() & not_skipped(MANIFEST_SKIP_DIRS))
    return sources(read_files(wanted_sources)), manifests(read_files(wanted_manifests))


def uploads(files: DataFrame, *keep: str) -> DataFrame:
    """Uploaded (name, content) under their base names; columns in `keep` are carried."""
    return files.select(basename(F.col("name")).alias("file_path"), basename(F.col("name")).alias("rel_path"), "content", *keep)


def uploaded(spark: SparkSession, name: str | None, content: bytes) -> DataFrame:
    """One file under its base name."""
    return uploads(spark.createDataFrame([(name, bytearray(content))], "name string, content binary"))


def sources(files: DataFrame) -> DataFrame:
    """(file_path, language, text) of the source files of (file_path, rel_path, content)."""
    own = files.withColumn("language", source_language()).where(F.col("language").isNotNull() & not_skipped(SOURCE_SKIP_DIRS))
    return own.select("file_path", "language", decode_source(F.col("content")).alias("text"))


def manifests(files: DataFrame) -> DataFrame:
    """(file_path, text) of the manifests; a name such as setup.py can be a source file too."""
    own = files.where(is_manifest() & not_skipped(MANIFEST_SKIP_DIRS))
    return own.select("file_path", decode_manifest(F.col("content")).alias("text"))


# The four files of the mock corpus.
MOCK_FILES = {
    "mock_vendor_app.py": """\
import rsa
from Crypto.Cipher import AES, DES
from Crypto.PublicKey import RSA, ECC
from Crypto.Hash import SHA1, MD5
import ecdsa
from cryptography.hazmat.primitives.asymmetric import rsa as crypto_rsa, ec

def sign_payload(data: bytes) -> bytes:
    private_key = rsa.generate_private_key(public_exponent=65537, key_size=2048)
    return private_key.sign(data)

def encrypt_legacy(data: bytes, key: bytes) -> bytes:
    cipher = AES.new(key, AES.MODE_CBC)
    return cipher.encrypt(data)
""",
    "requirements.txt": "rsa==4.9\npycryptodome==3.20.0\ncryptography==42.0.5\necdsa==0.19.0\nrequests==2.31.0\nfastapi==0.110.0\n",
    "package.json": json.dumps(
        {"name": "mock-frontend", "version": "1.0.0", "dependencies": {"node-rsa": "^1.1.1", "elliptic": "^6.5.4", "axios": "^1.6.0", "react": "^18.2.0"}}, indent=2
    ),
    "go.mod": "module github.com/mock/vendor-app\n\ngo 1.21\n\nrequire (\n    golang.org/x/crypto v0.17.0\n    github.com/golang-jwt/jwt/v5 v5.2.0\n)\n",
}


def mock_corpus(spark: SparkSession) -> DataFrame:
    rows = [(name, name, bytearray(text.encode())) for name, text in MOCK_FILES.items()]
    return spark.createDataFrame(rows, "file_path string, rel_path string, content binary")
