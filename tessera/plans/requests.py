"""Requests with a header, as a server would dispatch them."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from tessera.plans.engine import Engine
from tessera.schemas import REQUEST, SEARCH_MODE

OK, FAILED = 1, 2


@dataclass(frozen=True)
class Header:
    """Identity, type, status and times (epoch nanoseconds) of a request and its reply."""

    type: int
    id: str = ""
    status: int = OK
    error_code: int = 0
    error_message: str | None = None
    request_ts: int = 0
    response_ts: int = 0

    @staticmethod
    def of(kind: str) -> Header:
        return Header(REQUEST[kind], str(uuid.uuid4()), request_ts=time.time_ns())

    def failed(self, message: str, code: int = 1) -> Header:
        return replace(self, status=FAILED, error_code=code, error_message=message)


def dispatch(engine: Engine, header: Header, body: dict | None = None) -> tuple[Header, DataFrame | None]:
    """Run the request and return its header with status and reply time, and the reply, or none if it failed.

    Bodies: insert {documents, verbose?}; query {input, workspace_ids, doc_ids?, top_k?, search_mode?, rerank?, verbose?}; retrieve {workspace_id,
    document_id?, document_url?, verbose?}; delete {workspace_id, document_ids}; rerank {query, texts, return_text?}; health none.
    """
    body, reply = dict(body or {}), None
    done = lambda h: replace(h, response_ts=time.time_ns())
    try:
        if header.type == REQUEST["insert"]:
            reply = engine.insert(body["documents"], body.get("verbose", False))
        elif header.type == REQUEST["query"]:
            reply = engine.query(
                body["input"], workspaces=body["workspace_ids"], doc_ids=body.get("doc_ids") or (), top_k=body.get("top_k"),
                mode=body.get("search_mode") or SEARCH_MODE["both"], rerank=bool(body.get("rerank")), verbose=bool(body.get("verbose")),
            )
        elif header.type == REQUEST["retrieve"]:
            reply = engine.retrieve(body.get("workspace_id", ""), body.get("document_id"), body.get("document_url"), bool(body.get("verbose")))
        elif header.type == REQUEST["delete"]:
            reply = engine.delete(body.get("workspace_id", ""), body["document_ids"])
        elif header.type == REQUEST["rerank"]:
            reply = engine.rerank(body["query"], body["texts"], bool(body.get("return_text")))
        elif header.type == REQUEST["health"]:
            reply = engine.health()
        else:
            return done(header.failed(f"unknown request type {header.type}")), None
    except KeyError as e:
        return done(header.failed(f"the request has no {e.args[0]}")), None
    except ValueError as e:
        return done(header.failed(str(e))), None
    return done(header), reply
