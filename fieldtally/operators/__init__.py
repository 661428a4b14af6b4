"""DataFrame -> DataFrame operators, to be chained with ``DataFrame.transform``."""
