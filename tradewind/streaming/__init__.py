from tradewind.streaming.ingest import ingest_stream, open_csv_stream

__all__ = ["ingest_stream", "open_csv_stream"]
