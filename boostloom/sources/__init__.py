"""Reading samples and writing results."""

from boostloom.sources.sample import Sample, SampleReader

__all__ = ["Sample", "SampleReader"]
