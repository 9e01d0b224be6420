"""docweave: semi-structured analytics (CSV, JSON, XML, CBOR, MessagePack) on Spark DataFrames."""
