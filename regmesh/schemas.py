"""Fixed input schemas of the registry extracts.

Numbers and dates are declared as strings: extracts are dirty, so they are
converted afterwards with ``try_cast``/``try_to_date`` (see functions.normalize).
"""

from pyspark.sql.types import LongType, StringType, StructField, StructType


def _strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType(), True) for n in names])


# org-title, shape B
ORG_TITLE = _strings("orgName", "orgURI", "title")
# the same with a number, for typed reading
NUMBERED = StructType([*ORG_TITLE.fields, StructField("no", LongType(), True)])
# publication by organisation type
RESULTS = _strings("orgURI", "resultURI", "catLabel")
# full projected registry row used by the fixture round trip
PROJ = _strings("projectURI", "title", "acronym", "orgURI", "orgName", "country", "vatID",
                "pic", "proj", "budget", "sDate", "eDate", "source")
