from climo.functions import calendar, derive  # noqa: F401
