"""semestra: course-planning analytics as Spark DataFrame jobs.

Layout: ``functions`` (Column -> Column), ``operators`` (DataFrame ->
DataFrame building blocks), ``sources`` (readers, writers, key-value table
semantics), ``plans`` (the user-level queries), ``streaming`` (the attendance
stream).
"""

__version__ = "0.1.0"
