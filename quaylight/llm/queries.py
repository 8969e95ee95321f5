"""Queries of the training-data operators and, where SQL can say them, their SQL."""

from __future__ import annotations

from .chat import op5
from .decontaminate import op9
from .divergence import OP13_SQL, op13
from .fingerprints import op2, search
from .html import op3
from .mixing import op10
from .neardup import op1
from .neighbours import op11
from .sharding import op7
from .substrings import op6
from .toxicity import op8
from .warc import op4
from .whitening import op12

QUERIES = {
    "op1_simhash_neardup": op1,
    "op2_fingerprints": op2,
    "fingerprint_search": search,
    "op3_html_text": op3,
    "op4_warc": op4,
    "op5_chat": op5,
    "op6_repeats": op6,
    "op7_shards": op7,
    "op8_toxicity": op8,
    "op9_decontaminate": op9,
    "op10_mix": op10,
    "op11_neighbours": op11,
    "op12_whitening": op12,
    "op13_source_audit": op13,
}

ORACLES = {
    "op13_source_audit": OP13_SQL,
    "op4_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body FROM pages
        ), d AS (
            SELECT page_id, strlen(body) AS n, sha256(body) AS digest FROM p
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM d
        )
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f
    """,
}
