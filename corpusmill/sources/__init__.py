"""Sources and sinks: files of a corpus, reviews, signatures, chat logs; JSON lines and manifests."""
