"""Fetching pages over a transport: retries, states, threads by partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

#: Called with an address and the number of the try; gives a status code and a text.
Transport = Callable[[str, int], tuple[int, str]]
AGAIN = (502, 503, 504)


def fetch(get: Transport, url: str, tries: int = 10, again: tuple[int, ...] = AGAIN) -> tuple[int, str | None, int]:
    """SRC12, SRC14: (code, text, tries) of an address: states that may pass are tried
    again, any other answer stands; a transport that raises has code 0 and no text."""
    code, text = 0, None
    for n in range(1, tries + 1):
        try:
            code, text = get(url, n)
        except OSError:
            code, text = 0, None
        if code not in (0, *again):
            break
    return code, text if code == 200 else None, n


def _crawl(get: Transport, tries: int, threads: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with ThreadPoolExecutor(threads) as pool:
        for b in batches:
            got = list(pool.map(partial(fetch, get, tries=tries), b.column(1).to_pylist()))
            columns = [pa.array([x[i] for x in got], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], [b.schema.names[0], "code", "text", "tries"])


def crawl(urls: DataFrame, key: str, url: str, get: Transport, tries: int = 10, threads: int = 100) -> DataFrame:
    """SRC15, SRC16: (key, code, text, tries) of each row's address. Every partition
    fetches with its own threads and streams its rows; nothing is collected."""
    kind = urls.schema[key].dataType.simpleString()
    return urls.where(urls[url].isNotNull()).select(key, url).mapInArrow(partial(_crawl, get, tries, threads), f"{key} {kind}, code int, text string, tries int")
