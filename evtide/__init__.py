"""evtide: typed-event analytics and corpus preparation as declarative PySpark plans."""
