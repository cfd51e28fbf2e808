"""All registered queries."""

from flowmine.queries import balancing, cleaning, modelling, scoring, selecting, sequences, splitting  # noqa: F401
from flowmine.queries.common import QUERIES, SQL  # noqa: F401
