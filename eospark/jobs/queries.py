"""All registered queries and their SQL."""

from eospark.jobs import data_queries, loss_queries, metric_queries  # noqa: F401
from eospark.jobs.registry import QUERIES, SQL  # noqa: F401
