"""Remote services behind an injected transport, and the requests that go to them.

transport(method, url, body, headers, timeout) gives (status, bytes) or raises an
OSError; the default one uses the standard library. Answers land as files that are
written once, so that a rerun reads what was there.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ServiceError
from .files import immutable_write, stable_json_bytes

Transport = Callable[[str, str, bytes | None, dict, float], tuple[int, bytes]]
AGENT = "quernstone/1"
JSON_HEADERS = {"Content-Type": "application/json", "User-Agent": AGENT}
#: Seconds that a download and a request may take.
GET_SECONDS, POST_SECONDS = 180.0, 120.0
#: The four conditions of a search for structures without ligands (fixed values of the service).
SEARCH_CONDITIONS = (
    ("rcsb_polymer_entity_container_identifiers.reference_sequence_identifiers.database_accession", "exact_match", None),
    ("rcsb_polymer_entity_container_identifiers.reference_sequence_identifiers.database_name", "exact_match", "UniProt"),
    ("exptl.method", "exact_match", "X-RAY DIFFRACTION"),
    ("rcsb_entry_info.nonpolymer_entity_count", "equals", 0),
)


def urllib_transport(method: str, url: str, body: bytes | None, headers: dict, timeout: float) -> tuple[int, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data=body, headers=headers, method=method), timeout=timeout) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as error:
        return error.code, error.read()


def get(url: str, transport: Transport = urllib_transport) -> bytes:
    """The body of a download; any status but 200 is an error."""
    status, body = transport("GET", url, None, {"User-Agent": AGENT}, GET_SECONDS)
    if status != 200:
        raise ServiceError(f"{url}: status {status}")
    return body


def get_once(path: str | Path, url: str, transport: Transport = urllib_transport) -> bytes:
    """What has landed at path, else the download, which then lands there."""
    path = Path(path)
    if not path.exists():
        immutable_write(path, get(url, transport))
    return path.read_bytes()


def _posted(url: str, payload: dict, attempts: int, transport: Transport, wait: Callable[[float], None], read) -> dict:
    """Send until an answer can be read; waits of 1, 2, 4 ... seconds lie between the attempts."""
    body = json.dumps(payload, separators=(",", ":"), allow_nan=False).encode()
    last: object = None
    for k in range(attempts):
        try:
            value = read(*transport("POST", url, body, JSON_HEADERS, POST_SECONDS))
            if not isinstance(value, dict):
                raise ServiceError(f"{url} gave no object")
            return value
        except (OSError, json.JSONDecodeError) as error:
            last = error
        if k + 1 < attempts:
            wait(2.0**k)
    raise ServiceError(f"{url} failed after {attempts} attempts: {last}")


def post_json(url: str, payload: dict, attempts: int = 4, transport: Transport = urllib_transport, wait: Callable[[float], None] = time.sleep) -> dict:
    """The object that a service answers; one that lists errors is an error at once."""

    def read(status: int, body: bytes):
        if status != 200:
            raise OSError(f"status {status}")
        value = json.loads(body)
        if isinstance(value, dict) and value.get("errors"):
            raise ServiceError(f"{url}: {value['errors']}")
        return value

    return _posted(url, payload, attempts, transport, wait, read)


def post_search(url: str, payload: dict, attempts: int = 5, transport: Transport = urllib_transport, wait: Callable[[float], None] = time.sleep) -> dict:
    """The answer to a search; status 204 or an empty body says that nothing was found."""

    def read(status: int, body: bytes):
        if status == 204 or status == 200 and not body:
            return {"total_count": 0, "result_set": []}
        if status != 200:
            raise OSError(f"status {status}")
        return json.loads(body)

    return _posted(url, payload, attempts, transport, wait, read)


def search_payload(accession: str) -> dict:
    """Structures by X-ray diffraction of exactly this accession without nonpolymer entities."""
    terms = [{"type": "terminal", "service": "text", "parameters": {"attribute": a, "operator": o, "value": accession if x is None else x}} for a, o, x in SEARCH_CONDITIONS]
    return {"query": {"type": "group", "logical_operator": "and", "nodes": terms}, "return_type": "entry", "request_options": {"return_all_hits": True, "results_verbosity": "compact"}}


def search_request(accession: Column) -> Column:
    """The same request as compact JSON text for each accession of a column."""
    mark = "\x00accession\x00"
    before, after = json.dumps(search_payload(mark), separators=(",", ":")).split(json.dumps(mark))
    quoted = F.regexp_replace(F.regexp_replace(accession, r"\\", r"\\\\"), '"', r'\\"')
    return F.concat(F.lit(before + '"'), quoted, F.lit('"' + after))


def acquire(names: list[str], root: str | Path, fetch: Callable[[str], dict]) -> list[dict]:
    """Land one answer a name under root, each written once; a bounded list of names, as a service answers them one by one."""
    out = []
    for name in sorted(set(names)):
        path = Path(root) / f"{name}.json"
        if not path.exists():
            immutable_write(path, stable_json_bytes(fetch(name)))
        out.append({"name": name, "path": str(path), "bytes": path.stat().st_size})
    return out
