"""Training-data operators: packing, URL filters, language ID, exact top-k,
n-gram Jaccard join, HTML extraction, chat formatting, decontamination,
toxicity, quality, approximate nearest neighbours, conversation prefix trie and
hard-negative mining. Nothing else in the library imports this package."""
