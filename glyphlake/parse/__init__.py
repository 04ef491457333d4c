"""CommonMark and GFM parsing of one document into facts with byte ranges."""
