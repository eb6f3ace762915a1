"""Token counts that follow edits: a segment tree over each document's pieces.

A document is split into pieces; a tree holds pieces, characters and ids under every node, its root
the document's count. An edit replaces the pieces it overlaps, together with some pieces of context up
to a boundary that no split crosses. Only these are split and encoded again, and only the sums on the
paths to them change.

A null text is an empty one (count 0). The edits of a document are applied from the last position to
the first, so that positions refer to the text before. A null or negative position or length counts
as 0, a position past the end as the end, a null insertion as none. A document without edits keeps its
count. Repeated edits are applied each; edits of documents that are not there have no effect. Rows
without an id and repeated rows are counted each; edits of one position go by the characters they delete,
then by what they put in. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.frames import keyed_texts, map_rows
from mailsift.llm.packing import pieces_by_library
from mailsift.llm.pretokens import OTHER, segments, specials

LEAF, FAN = 64, 16


class Node:
    """Some pieces (a leaf) or child nodes, and the sums over them."""

    __slots__ = ("children", "chars", "ids", "n", "pieces")

    def __init__(self, pieces: list[str] | None, children: list[Node] | None, n: int, chars: int, ids: int):
        self.pieces, self.children, self.n, self.chars, self.ids = pieces, children, n, chars, ids


class CountedText:
    """A text as a tree of counted pieces."""

    CONTEXT = 3

    def __init__(self, text: str, path: str):
        self.path = path
        self.known = pieces_by_library(path)
        self.added = specials(path)[0]
        self.encoded = 0
        self.root = self._over(self._leaves(self._split(text)))

    def _split(self, text: str) -> list[str]:
        by_id = {number: content for content, number in self.added.items()}
        out: list[str] = []
        for special, run in segments(text, self.path):
            out.extend(run if special is None else [by_id[special]])
        return out

    def _count(self, pieces: list[str]) -> int:
        if self.added.keys().isdisjoint(pieces):
            return sum(map(len, map(self.known.__getitem__, pieces))) // 4
        return sum(1 if p in self.added else len(self.known[p]) // 4 for p in pieces)

    def _leaves(self, pieces: list[str]) -> list[Node]:
        parts = (pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF))
        return [Node(p, None, len(p), sum(map(len, p)), self._count(p)) for p in parts]

    @staticmethod
    def _over(nodes: list[Node]) -> Node:
        """One node above all ``nodes``."""
        if not nodes:
            return Node([], None, 0, 0, 0)
        while len(nodes) > 1:
            nodes = [CountedText._parent(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
        return nodes[0]

    @staticmethod
    def _parent(children: list[Node]) -> Node:
        sums = (sum(getattr(c, field) for c in children) for field in ("n", "chars", "ids"))
        return Node(None, children, *sums)

    @property
    def total(self) -> int:
        return self.root.ids

    @property
    def n_pieces(self) -> int:
        return self.root.n

    def piece(self, i: int) -> str:
        node = self.root
        while node.children is not None:
            for child in node.children:
                if i < child.n:
                    node = child
                    break
                i -= child.n
        return node.pieces[i]

    def locate(self, position: int) -> tuple[int, int]:
        """Index of the piece that holds a character and the place in it; past the end, the number of pieces."""
        node, before = self.root, 0
        if position >= node.chars:
            return node.n, 0
        while node.children is not None:
            for child in node.children:
                if position < child.chars:
                    node = child
                    break
                position -= child.chars
                before += child.n
        for i, piece in enumerate(node.pieces):
            if position < len(piece):
                return before + i, position
            position -= len(piece)
        raise AssertionError("sums of characters do not fit the pieces")

    def edit(self, position: int, delete: int, insert: str) -> None:
        """Replace ``delete`` characters from ``position`` on by ``insert``."""
        position = min(max(position, 0), self.root.chars)
        stop = min(position + max(delete, 0), self.root.chars)
        if position == stop and not insert:
            return
        first, into = self.locate(position)
        last, over = self.locate(stop)
        lo = max(first - self.CONTEXT, 0)
        while not self._sure(lo):
            lo -= 1
        hi = min(last + (over > 0) + self.CONTEXT, self.n_pieces)
        while not self._sure(hi):
            hi += 1
        old = [self.piece(i) for i in range(lo, hi)]
        start = sum(map(len, old[: first - lo])) + into
        end = sum(map(len, old[: last - lo])) + over
        whole = "".join(old)
        fresh = self._split(whole[:start] + insert + whole[end:])
        self.encoded += len(fresh)
        self.root = self._over(self._replace(self.root, lo, hi, fresh))

    def _sure(self, i: int) -> bool:
        """Whether the boundary before piece ``i`` stands whatever changes on one side of it.

        It does at the ends, and between a letter or digit and a blank with a letter or digit.
        """
        if i <= 0 or i >= self.n_pieces:
            return True
        near = self.piece(i - 1)[-1] + self.piece(i)[:2]
        return len(near) == 3 and near[1] == " " and near[0].isalnum() and near[2].isalnum() and not OTHER.search(near)

    def _replace(self, node: Node, lo: int, hi: int, fresh: list[str]) -> list[Node]:
        """Nodes that stand for ``node`` once its pieces ``lo`` to ``hi`` are ``fresh``."""
        if node.children is None:
            pieces = node.pieces[:lo] + fresh + node.pieces[hi:]
            if len(pieces) > 2 * LEAF:
                return self._leaves(pieces)
            ids = node.ids - self._count(node.pieces[lo:hi]) + self._count(fresh)
            return [Node(pieces, None, len(pieces), sum(map(len, pieces)), ids)] if pieces else []
        children, at, placed = [], 0, False
        for child in node.children:
            a, b = max(lo - at, 0), min(hi - at, child.n)
            if a < b or (not placed and a == b <= child.n and lo - at <= child.n and hi <= at + child.n):
                children += self._replace(child, a, b, [] if placed else fresh)
                placed = True
            else:
                children.append(child)
            at += child.n
        if not children:
            return []
        parts = [children[i : i + FAN] for i in range(0, len(children), FAN)] if len(children) > 2 * FAN else [children]
        return [self._parent(p) for p in parts]


def whole_number(value) -> int:
    return max(int(value or 0), 0)


def count_with_edits(documents: DataFrame, edits: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts before and after each document's edits.

    ``edits`` has doc_id, position, delete, insert. The edits of one document travel as one array
    beside its text; they are meant to be few next to the text itself.
    """
    edit = F.struct("position", "delete", "insert")
    of_doc = edits.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(edit).alias("edits"))
    texts = keyed_texts(documents, key, text)
    return counted(texts.join(of_doc, texts["doc_id"] == of_doc["_id"], "left").drop("_id"), path)


def counted(texts: DataFrame, path: str) -> DataFrame:
    """As ``count_with_edits``, for rows of doc_id, text and an array ``edits``."""

    def order(edit: dict) -> tuple:
        return whole_number(edit["position"]), whole_number(edit["delete"]), edit["insert"] or ""

    def rows(slices):
        for part in slices:
            out = []
            for doc_id, text, edits in zip(part["doc_id"], part["text"], part["edits"], strict=True):
                doc = CountedText(text or "", path)
                before, pieces = doc.total, doc.n_pieces
                todo = sorted(map(order, edits or []), reverse=True)
                for position, delete, insert in todo:
                    doc.edit(position, delete, insert)
                out.append((doc_id, before, pieces, doc.total, doc.n_pieces, doc.encoded, len(todo)))
            yield out

    ddl = (
        "doc_id long, n_tokens long, n_pieces long, edited_tokens long, edited_pieces long, "
        "reencoded_pieces long, n_edits int"
    )
    return map_rows(texts, rows, ddl)
