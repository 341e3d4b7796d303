"""tabprobe.ml"""
