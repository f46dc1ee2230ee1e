"""Kinds of operators by name, and what belongs to each kind.

A maker takes the parameters of a configuration and returns what its kind asks for:
chunker       documents (doc_id, text) -> (doc_id, chunk_no, chunk_id, text)
embedder      an Embedder
index         an Index
retriever     (queries, chunks, embedder, k) -> hits
reranker      (hits with query and text, top_n) -> hits
repacker      (rank, number of hits) -> place
summarizer    hits with query and text -> the same with shorter texts
query_classifier  question -> struct(needs_retrieval, confidence)
prompt        (array of texts, question) -> prompt
generator     prompts -> answers
splitter      text -> array of sentences
judge         keyed examples -> scores
"""

from __future__ import annotations


class Registry:
    """Makers by kind and name. A plugin registers itself when its module is imported."""

    def __init__(self) -> None:
        self.made: dict[tuple[str, str], object] = {}

    def register(self, kind: str, *names: str):
        def put(maker):
            for name in names:
                if self.made.setdefault((kind, name), maker) is not maker:
                    raise ValueError(f"{kind} {name!r} is registered already")
            return maker

        return put

    def available(self, kind: str) -> list[str]:
        return sorted(n for k, n in self.made if k == kind)

    def build(self, kind: str, name: str, **parameters):
        if (kind, name) not in self.made:
            raise KeyError(f"unknown {kind} {name!r}, there are {self.available(kind)}")
        return self.made[kind, name](**parameters)


OPERATORS = Registry()
register = OPERATORS.register
