"""Writers: run files, responses, stored indexes."""
