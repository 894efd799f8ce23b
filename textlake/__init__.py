"""textlake: building, auditing and inspecting text corpora on Spark."""
