"""Profile tables of any size on Spark, and say how fit they are for use."""

from plumbline.profile import Profile
from plumbline.report import full_profile
from plumbline.sources.readers import assert_nonempty, read_table
from plumbline.sources.sinks import write_report

__all__ = ["Profile", "assert_nonempty", "full_profile", "read_table", "write_report"]
