"""tabprobe.sources"""
