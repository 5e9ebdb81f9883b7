"""Keyed state of the newest versions of a document's pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessor

CHANGES = "doc_id string, page int, version long, op string, text string, at timestamp"


def newest_pages(ttl_seconds: int) -> StatefulProcessor:
    """A processor for :func:`quire.streaming.streams.page_changes`."""

    # Nested, so that it is shipped whole and executors need no package install.
    class NewestPages(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.versions = handle.getMapState("versions", "page int", "version long")
            self.until = handle.getValueState("until", "millis long")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            # The state is asked once for a page and told once what became of it.
            last, out, seen, fresh = 0, [], {}, set()
            for batch in rows:
                order = batch.sort_values(["version", "page"], kind="stable")
                for page, version, text, ts in zip(order["page"], order["version"], order["text"], order["ts"], strict=True):
                    last = max(last, int(ts.timestamp() * 1000))
                    page, version = int(page), int(version)
                    if page not in seen:
                        held = self.versions.getValue((page,))
                        seen[page] = None if held is None else held[0]
                    known = seen[page]
                    if known is not None and known >= version:
                        continue
                    if known is not None:
                        out.append((key[0], page, known, "delete", None, ts))
                    out.append((key[0], page, version, "put", text, ts))
                    seen[page] = version
                    fresh.add(page)
            for page in fresh:
                self.versions.updateValue((page,), (seen[page],))
            held = self.until.get()
            until = max(last + ttl_seconds * 1000, held[0] if held is not None else 0)
            if held is None or until > held[0]:
                if held is not None:
                    self.handle.deleteTimer(held[0])
                self.handle.registerTimer(until)
                self.until.update((until,))
            yield _frame(pd, out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
            out = [(key[0], page[0], version[0], "delete", None, at) for page, version in self.versions.iterator()]
            self.versions.clear()
            self.until.clear()
            yield _frame(pd, out)

        def close(self) -> None:
            pass

    def _frame(pd, rows):
        frame = pd.DataFrame(rows, columns=["doc_id", "page", "version", "op", "text", "at"])
        return frame.astype({"page": "int32", "version": "int64"}).assign(at=pd.to_datetime(frame["at"]))

    return NewestPages()


def texts_to_stand() -> Callable:
    """Task that takes the text from deliveries which a newer one in the same Arrow batch outdates.

    The newer one must not be earlier in event time, or it might be dropped as late where the
    older one is not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            at = batch.schema.get_field_index
            docs, pages, versions = (batch.column(at(c)).to_pylist() for c in ("doc_id", "page", "version"))
            times = batch.column(at("ts")).cast(pa.int64()).to_pylist()
            rows = [i for i, v in enumerate(zip(docs, pages, versions, times, strict=True)) if None not in v]
            # Of each page the version that is looked at, its latest time, and that of all newer ones.
            known, outdated = {}, np.zeros(len(batch), bool)
            for i in sorted(rows, key=lambda i: versions[i], reverse=True):
                version, latest, newer = known.get((docs[i], pages[i]), (versions[i], times[i], None))
                if versions[i] < version:
                    version, latest, newer = versions[i], times[i], latest if newer is None else max(latest, newer)
                known[docs[i], pages[i]] = version, max(latest, times[i]), newer
                outdated[i] = newer is not None and newer >= times[i]
            text = batch.column(at("text"))
            left = pc.if_else(pa.array(outdated), pa.scalar(None, text.type), text)
            yield batch.set_column(at("text"), batch.schema.field(at("text")), left)

    return run
