import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gaugeworks import schemas  # noqa: E402
from gaugeworks.session import build_session, clear_scratch  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
           "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_scratch(session)
    session.stop()


TICKET = dict(
    ticket_id="T1", customer_id="C1", department="Billing", issue_type="Refund Delay", priority="Low", agent="Ava",
    channel="Email", created_at=datetime(2025, 1, 1), sla_due_at=datetime(2025, 1, 2), closed_at=None, status="Open",
    resolution_hours=None, previous_contacts=0, customer_message="hello", customer_rating=4,
)


@pytest.fixture
def tickets(spark):
    """Make a ticket table from the given changes to a plain ticket, one per row."""

    def make(*changes):
        rows = [tuple({**TICKET, "ticket_id": f"T{i}", **c}.values()) for i, c in enumerate(changes, start=1)]
        return spark.createDataFrame(rows, schemas.TICKETS)

    return make
