"""Files elsewhere: addresses on the web are fetched into the shared folder, object stores are read by Spark itself."""

from __future__ import annotations

import re
import ssl
import urllib.request
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession

#: Bytes that are fetched from one address, at most.
MOST_BYTES = 1 << 30


def is_url(x: object) -> bool:
    """Whether a text is an address with a scheme and a host, for the web."""
    if not isinstance(x, str):
        return False
    parts = urlparse(x)
    return parts.scheme in ("http", "https") and bool(parts.netloc)


def is_s3(x: object) -> bool:
    return isinstance(x, str) and re.match(r"s3[an]?://[^/]+/.+", x) is not None


def s3_path(spark: SparkSession, uri: str, access_key: str | None = None, secret_key: str | None = None, session_token: str | None = None, endpoint: str | None = None) -> str:
    """The path by which Spark reads an object; credentials, if given, are set, else the cluster's own (or a role's) count."""
    if not is_s3(uri):
        raise ValueError(f"no address of an object: {uri}")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    given = {"access.key": access_key, "secret.key": secret_key, "session.token": session_token, "endpoint": endpoint}
    for k, v in given.items():
        if v is not None:
            conf.set(f"fs.s3a.{k}", v)
    if session_token is not None:
        conf.set("fs.s3a.aws.credentials.provider", "org.apache.hadoop.fs.s3a.TemporaryAWSCredentialsProvider")
    return re.sub(r"^s3[an]?://", "s3a://", uri)


def fetched(spark: SparkSession, url: str, folder: str, verify: bool = True, most: int = MOST_BYTES) -> str:
    """A web file's copy in `folder`, which all nodes share; raises beyond `most` bytes."""
    if not is_url(url):
        raise ValueError(f"no address on the web: {url}")
    context = None if verify else ssl._create_unverified_context()
    jvm = spark.sparkContext._jvm
    path = f"{folder.rstrip('/')}/fetched-{uuid.uuid4().hex}{''.join(re.findall(r'[.][A-Za-z0-9]+$', urlparse(url).path))}"
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    n = 0
    try:
        with urllib.request.urlopen(url, context=context) as got:
            while part := got.read(1 << 20):
                n += len(part)
                if n > most:
                    raise ValueError(f"{url} has over {most} bytes")
                out.write(bytearray(part))
    finally:
        out.close()
    return path
