"""Every registered query of the photo operators, by name, with its oracle SQL."""

from . import archive, detail, develop, grading, wider

QUERIES: dict = {**grading.QUERIES, **archive.QUERIES, **detail.QUERIES, **wider.QUERIES, **develop.QUERIES}
ORACLES: dict = {**grading.ORACLES, **archive.ORACLES, **detail.ORACLES, **wider.ORACLES, **develop.ORACLES}
