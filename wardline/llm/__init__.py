"""Training-data operators: search, dedup, classification, encoding, archives, scans and extraction.

Nothing outside this subpackage imports it.  Modules:

``common``        shared-folder scratch tables, file access, text batches
``topk_search``   exact top-k by columnar branch-and-bound
``simhash``       SimHash fingerprints and the binary trie self-join
``components``    connected components of a link table
``quality_cnn``   byte-level convolutional network
``huffman``       length-limited canonical Huffman token files
``repeats``         substring dedup by line and sentence hashing
``warc``          zstd WARC archives with a dictionary frame
``bpe_fst``       byte-level BPE as a lazily determinised transducer
``positional``    distributed positional inverted index, decontamination
``secrets``       assignment-aware secret scan
``html_text``     text-to-tag-ratio main text extraction
``queries``       the registered queries and their SQL
"""
