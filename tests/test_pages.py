"""Reading pages holds a bounded number of them."""

import pandas as pd

from quotelab.functions.words import read_pages
from quotelab.session import SETTINGS


def test_rows_leave_before_all_pages_of_a_batch_are_read():
    markup = "<a href='/en/x'>x</a>" * 10_000
    batch = pd.DataFrame({"url": [f"https://h/{i}" for i in range(20)], "html": [markup] * 18 + [None, "<p>last"]})
    out = list(read_pages(iter([batch, batch[:0]])))
    assert len(out) > 2 and max(len(x) for x in out) < 8
    rows = pd.concat(out)
    assert rows["url"].tolist() == batch["url"].tolist()
    assert rows["text"].tolist()[-2:] == ["", "last"] and {len(x) for x in rows["links"]} == {10_000, 0}


def test_a_batch_is_bounded_by_bytes():
    assert int(SETTINGS["spark.sql.execution.arrow.maxBytesPerBatch"]) <= 16 << 20
