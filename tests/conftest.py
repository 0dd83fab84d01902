import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

MESSAGE = "delivery_id long, id long, date string, date_unixtime long, from_name string, from_id string, reply_to_message_id long, forwarded_from string, forwarded_from_id string, text_plain string, text_length int, has_media int, has_photo int, has_links int, has_mentions int, is_edited int, edited_unixtime long, lang string"


@pytest.fixture(scope="session")
def spark():
    from chatlake.session import build_session

    session = build_session("tests", cores=4, **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def chat(spark):
    """Message rows from short dicts; what a dict leaves out is null, but for counters."""
    names = [c.split()[0] for c in MESSAGE.split(",")]

    def make(*rows: dict):
        full = []
        for n, row in enumerate(rows, 1):
            base = dict.fromkeys(names) | {"delivery_id": n, "date_unixtime": 0, "has_media": 0, "has_photo": 0, "has_links": 0, "has_mentions": 0, "is_edited": 0}
            row = base | row
            if row["text_plain"] is not None:
                row["text_length"] = len(row["text_plain"])
            full.append(tuple(row[c] for c in names))
        return spark.createDataFrame(full, MESSAGE)

    return make
