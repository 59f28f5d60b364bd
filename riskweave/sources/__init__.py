"""Where data enters and leaves: change streams, tables, sinks."""
