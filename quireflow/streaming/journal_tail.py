"""The journal as a stream: committed page versions, as markers come in.

Records of a log arrive in order of their file offset. Pages wait in the
operator's state, the latest version of each only, until a marker covers
their sequence; then they are emitted and their wait is over. State is bounded
by the pages dirtied between two markers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "log string, entry string, page_index bigint, sequence bigint, data binary, commit_sequence bigint"
_STATE = "entries array<string>, pages array<bigint>, sequences array<bigint>, datas array<binary>"


def committed_pages(journal: DataFrame) -> DataFrame:
    """``journal`` (streaming; log, file_offset, kind, sequence, entry, page_index, data, commit_sequence) -> committed page versions.

    Of the versions one marker covers, the latest of each page is emitted.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting: dict[tuple, tuple] = {}
        if state.exists:
            for e, p, s, d in zip(*state.get):
                waiting[(e, p)] = (s, d)
        rows = pd.concat(list(batches)).sort_values("file_offset", kind="stable")
        out = []
        for r in rows.itertuples():
            if r.kind == "DATA":
                waiting[(r.entry, int(r.page_index))] = (int(r.sequence), r.data)
            elif r.kind == "COMMIT":
                upto = int(r.commit_sequence)
                for k in [k for k, v in waiting.items() if v[0] <= upto]:
                    s, d = waiting.pop(k)
                    out.append((key[0], k[0], k[1], s, d, upto))
        state.update(([k[0] for k in waiting], [k[1] for k in waiting], [v[0] for v in waiting.values()], [v[1] for v in waiting.values()]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    return journal.groupBy("log").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
