"""tabprobe.streaming"""
