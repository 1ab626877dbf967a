"""Feature plans by kind of data set, and the registered queries."""
