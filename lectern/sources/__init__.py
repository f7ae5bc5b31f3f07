"""Files, catalogues and injected external tools as DataFrames."""
