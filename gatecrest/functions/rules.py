"""Rules that classify an operation by its identity, as data.

One rule a line, in order of precedence: pattern, category, severity and, for scripts, the resource hint and whether state
changes. In patterns, braces hold alternatives, ``~`` stands for any further members, ``%`` for one word, a leading
``*`` for anything before. All match without regard to case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

CATEGORIES = {"shell": "shell_execution", "code": "code_execution", "file": "file_operation", "api": "api_call", "db": "database_operation", "tool": "tool_call"}
RANK = {name: k for k, name in enumerate(("critical", "warning", "info", "suppressed"))}


@dataclass(frozen=True)
class Rule:
    regex: str
    category: str
    severity: str
    hint: str | None
    writes: bool


def compiled(pattern: str) -> str:
    """The Java regular expression of a pattern."""
    start, s = ("", pattern[1:]) if pattern[0] == "*" else ("^", pattern)
    s = re.sub(r"(?<!\\)[.](?![*])", r"\\.", s)
    for a, b in (("~", r"(?:\.[a-z_][0-9a-z_]*)*"), ("%a", "[a-z_]+"), ("%", r"\w+"), ("{", "(?:"), ("}", ")"), (",", "|")):
        s = s.replace(a, b)
    return f"(?i){start}{s}$"


def parse(table: str) -> list[Rule]:
    out = []
    for line in table.strip().splitlines():
        pattern, category, severity, *rest = line.split()
        hint, writes = (rest[0], rest[1] == "writes") if rest else (None, severity != "info")
        out.append(Rule(compiled(pattern), CATEGORIES[category], severity, None if hint in (None, "-") else hint, writes))
    return out


PYTHON_RESOLVED = parse(r"""
builtins.{eval,exec}  code critical
subprocess.{Popen,call,check_call,check_output,getoutput,getstatusoutput,run}  shell critical
asyncio.create_subprocess_{exec,shell}  shell critical
os.{exec.*,popen,popen2,popen3,popen4,spawn[lv]p?e?,system}  shell critical
shutil.rmtree  file critical
os.{remove,removedirs,rmdir,unlink}  file critical
pathlib.Path~.{rmdir,unlink}  file critical
pathlib.Path~.{mkdir,touch,write_bytes,write_text}  file warning
pathlib.Path~.{glob,iterdir,read_bytes,read_text,rglob}  file info
builtins.open  file info
builtins.open.{write,writelines}  file warning
builtins.open.{read,readline,readlines}  file info
requests.{get}  api warning
requests.{delete,patch,post,put,request}  api warning
requests.Session.{get}  api warning
requests.Session.{delete,patch,post,put,request}  api warning
httpx.{get}  api warning
httpx.{delete,patch,post,put,request}  api warning
httpx.Client.{get}  api warning
httpx.Client.{delete,patch,post,put,request}  api warning
httpx.AsyncClient.{get}  api warning
httpx.AsyncClient.{delete,patch,post,put,request}  api warning
aiohttp.ClientSession.{get}  api warning
aiohttp.ClientSession.{delete,patch,post,put,request}  api warning
urllib.request.{Request,urlopen,urlretrieve}  api warning
smtplib.SMTP  api warning
smtplib.SMTP~.{send_message,sendmail}  api warning
{psycopg2,sqlite3}~.executescript  db critical
{psycopg2,sqlite3}~.executemany  db warning
{psycopg2,sqlite3}~.execute  db info
{psycopg2,sqlite3}~.fetch{all,many,one}  db info
{psycopg2,sqlite3}~.commit  db warning
redis.Redis~.{delete,expire,set}  db warning
redis.Redis~.{flushall,flushdb}  db critical
redis.Redis~.{get,keys}  db info
urllib3.HTTPConnectionPool.{request,urlopen}  api warning
urllib3.PoolManager.{request,urlopen}  api warning
http.client.HTTPConnection.{endheaders,putrequest,request}  api warning
http.client.HTTPSConnection.{endheaders,putrequest,request}  api warning
httpcore.{AsyncRequest,Request}  api warning
treq.{delete,get,patch,post,put,request}  api warning
asks.{delete,get,patch,post,put,request}  api warning
niquests.{delete,get,patch,post,put,request}  api warning
niquests.Session.{delete,get,patch,post,put,request}  api warning
asyncpg.Connection.{execute,executemany,fetch,fetchrow,fetchval}  db warning
asyncpg.Pool.{execute,executemany,fetch,fetchrow,fetchval}  db warning
aiomysql.Connection.{cursor,execute}  db warning
aiomysql.Cursor.{execute,executemany,fetchall,fetchmany,fetchone}  db warning
databases.Database.{execute,fetch_all,fetch_one,fetch_val,iterate}  db warning
peewee.Model.{create,delete_instance,get_or_create,save}  db warning
peewee.%.{delete,insert,update}  db warning
tortoise.Model.{bulk_create,bulk_update,create,delete,save,update}  db warning
tortoise.queryset.QuerySet.{create,delete,update}  db warning
sqlmodel.Session.{add,add_all,commit,delete,exec}  db warning
motor.motor_asyncio.%.{delete_many,delete_one,insert_many,insert_one,replace_one,update_many,update_one}  db warning
pymongo.collection.Collection.{bulk_write,delete_many,delete_one,insert_many,insert_one,replace_one,update_many,update_one}  db warning
celery.Celery.{send_task,signature}  api warning
celery.Task.{apply_async,delay,s,si}  api warning
rq.Queue.{enqueue,enqueue_at,enqueue_call,enqueue_in}  api warning
pika.channel.Channel.{basic_publish,publish}  api warning
kafka.KafkaProducer.{send,send_and_wait}  api warning
confluent_kafka.Producer.{flush,poll,produce}  api warning
boto3.client.{delete_object,put_object,upload_file,upload_fileobj}  api warning
boto3.resource..*.{delete,put,upload_file,upload_fileobj}  api warning
google.cloud.storage.Blob.{delete,upload_from_file,upload_from_filename,upload_from_string}  api warning
azure.storage.blob.BlobClient.{delete_blob,upload_blob}  api warning
sh.%  shell critical
plumbum.local.%  shell critical
plumbum.machines..*.session.run  shell critical
invoke.run  shell critical
invoke.context.Context.run  shell critical
socket.socket.{connect,send,sendall,sendto}  api warning
paramiko.SSHClient.{exec_command,invoke_shell}  shell critical
paramiko.SFTPClient.{put,putfo,remove,rename,rmdir}  file warning
""")

PYTHON_FALLBACK = parse(r"""
subprocess.{Popen,call,check_call,check_output,getoutput,getstatusoutput,run}  shell critical
asyncio.create_subprocess_{exec,shell}  shell critical
os.{exec.*,popen,popen2,popen3,popen4,system}  shell critical
os.{spawn[lv]p?e?}  shell critical
commands.{getoutput,getstatusoutput}  shell critical
pty.{fork,spawn}  shell critical
pexpect.{run,spawn}  shell critical
fabric.{local,run,sudo}  shell critical
*.exec_command  shell critical
eval  code critical
exec  code critical
pickle.{Unpickler,load,loads}  code critical
marshal.{load,loads}  code critical
shelve.open  code critical
yaml.{full_load,load,unsafe_load}  code critical
dill.{load,loads}  code critical
joblib.load  code critical
ctypes.{CDLL,PyDLL,WinDLL}  code critical
shutil.rmtree  file critical
os.{remove,removedirs,rmdir,unlink}  file critical
*.unlink  file critical
*.rmdir  file critical
*.rmtree  file critical
*.write_text  file warning
*.write_bytes  file warning
shutil.{copy,copy2,copyfile,copyfileobj,copytree,make_archive,move}  file warning
os.{link,rename,renames,replace,symlink}  file warning
os.{makedirs,mkdir}  file warning
os.{chmod,chown}  file warning
*.mkdir  file warning
*.write  file warning
*.touch  file warning
*.extractall  file warning
requests.{Session.delete,Session.patch,Session.post,Session.put,Session.request,delete,patch,post,put,request}  api warning
requests.{Session.get,Session.head,Session.options,get,head,options}  api info
httpx.{delete,patch,post,put,request}  api warning
httpx.{get,head,options}  api info
httpx.{AsyncClient,Client}.{delete,patch,post,put,request}  api warning
httpx.{AsyncClient,Client}.{get,head,options}  api info
aiohttp.ClientSession.{delete,patch,post,put,request}  api warning
aiohttp.ClientSession.{get,head,options}  api info
urllib.request.{Request,urlopen,urlretrieve}  api warning
urllib3.{HTTPConnectionPool,HTTPSConnectionPool,PoolManager}.{request,urlopen}  api warning
boto3.client.%a  api warning
boto3.resource.%a  api warning
*.{delete,patch,post,put}  api warning
sqlite3.{Connection,Cursor}.{execute,executemany,executescript}  db warning
*.execute  db warning
*.executemany  db warning
*.executescript  db critical
psycopg2.{connection,cursor}.{execute,executemany}  db warning
asyncpg.Connection.{execute,executemany,fetch,fetchrow,fetchval}  db warning
*.session.{add,add_all,commit,delete,execute,flush,merge}  db warning
*.objects.{bulk_create,bulk_update,create,delete,get_or_create,update}  db warning
*.objects.{all,filter,first,get,last,prefetch_related,select_related}  db info
*.{bulk_create,bulk_update}  db warning
*.{bulk_write,delete_many,delete_one,insert_many,insert_one,replace_one,update_many,update_one}  db warning
*.{aggregate,count_documents,distinct,find,find_one}  db info
*.{append,decr,delete,expire,hdel,hset,incr,lpush,mset,msetnx,rpush,sadd,set,setex,zadd}  db warning
*.{exists,get,hget,hgetall,keys,lrange,mget,smembers,ttl,zrange}  db info
*.{flushall,flushdb}  db critical
*.insert  db warning
open  file info
*.{write_bytes,write_text}  file warning
*.mkdir  file warning
*.touch  file warning
*.{write,writelines}  file warning
shutil.{copy,copy2,copyfile,copyfileobj,copytree,make_archive,move}  file warning
os.{link,rename,renames,replace,symlink}  file warning
os.{makedirs,mkdir}  file warning
os.{chmod,chown}  file warning
*.extractall  file warning
*.{read_bytes,read_text}  file info
*.{read,readline,readlines}  file info
*.{glob,iterdir,rglob}  file info
os.{listdir,scandir,walk}  file info
smtplib.SMTP  api warning
*.{send_email,send_message,sendmail}  api warning
*.{fetchall,fetchmany,fetchone}  db info
""")

SCRIPT_RESOLVED = parse(r"""
child_process.{exec,execSync}  shell critical shell writes
child_process.{spawn,spawnSync}  shell critical process writes
child_process.{execFile,execFileSync}  shell critical file writes
child_process.fork  shell critical process writes
Bun.{file,shell,spawn,spawnSync,write}  shell critical process writes
Deno.{Command,create,execPath,run}  shell critical process writes
execa{.{command,commandSync,node,sync}}?  shell critical shell writes
shelljs.{cat,cd,chmod,cp,dirs,echo,env,exec,exit,grep,head,ln,mkdir,mv,popd,pushd,rm,sed,sort,tail,touch,uniq,which}  shell critical shell writes
\$`.*`  shell critical shell writes
eval  code critical - writes
Function  code critical - writes
vm.{compileFunction,runInContext,runInNewContext,runInThisContext}  code critical - writes
vm.Script  code critical - writes
fs.{unlink,unlinkSync}  file critical file writes
fs.{rm,rmSync}  file critical file writes
fs.{rmdir,rmdirSync}  file critical directory writes
fs/promises.{rm,rmdir,unlink}  file critical file writes
fse?.{emptyDir,emptyDirSync,remove,removeSync}  file critical file writes
rimraf{.sync}?  file critical directory writes
del{.sync}?  file critical file writes
fs.{writeFile,writeFileSync}  file warning file writes
fs.{appendFile,appendFileSync}  file warning file writes
fs.createWriteStream  file warning file writes
fs.{mkdir,mkdirSync}  file warning directory writes
fs.{rename,renameSync}  file warning file writes
fs.{copyFile,copyFileSync}  file warning file writes
fs.{chmod,chmodSync,chown,chownSync}  file warning file writes
fs/promises.{appendFile,chmod,chown,copyFile,mkdir,rename,writeFile}  file warning file writes
fse?.{copy,copySync,ensureDir,ensureDirSync,mkdirp,mkdirpSync,move,moveSync,outputFile,outputFileSync,writeFile,writeFileSync}  file warning file writes
fetch  api warning http reads
axios.{delete,patch,post,put,request}  api warning http writes
axios  api warning http writes
axios.{get,head,options}  api info http reads
got.{delete,patch,post,put}  api warning http writes
got{.{get,stream}}?  api info http reads
superagent.{del,delete,patch,post,put}  api warning http writes
superagent.{get,head}  api info http reads
node-fetch  api warning http reads
undici.{fetch,pipeline,request,stream}  api warning http reads
request.{del,delete,patch,post,put}  api warning http writes
request{.{get,head}}?  api info http reads
ky.{delete,patch,post,put}  api warning http writes
ky.{get,head,options}  api info http reads
needle.{delete,patch,post,put}  api warning http writes
needle.{get,head,request}  api info http reads
{crossFetch,isomorphicFetch}  api warning http reads
{api,apiClient,client,http,httpClient,https}.{delete,patch,post,put,request}  api warning http writes
{api,apiClient,client,http,httpClient,https}.{get,head,options}  api info http reads
runtime.{call,fetch,generateObject,generateText,invoke,useModel}  tool warning runtime writes
runtime.{createMemory,deleteMemory,getMemory,searchMemories,updateMemory}  db warning - writes
{agent,chain,llm,model}.{acall,ainvoke,apredict,arun,astream,call,invoke,predict,run,stream}  tool warning - writes
llm.{achat,acomplete,chat,complete,stream_chat,stream_complete}  tool warning - writes
{client,openai}.{chat.completions.create,completions.create,embeddings.create,images.generate}  tool warning - reads
{anthropic,client}.messages.create  tool warning - reads
*.{delete,patch,post,put}  api warning http writes
prisma.%.{create,createMany,delete,deleteMany,update,updateMany,upsert}  db warning - writes
prisma.\$executeRaw{Unsafe}?  db critical - writes
prisma.\$queryRaw{Unsafe}?  db warning - reads
prisma.%.findMany  db info - reads
prisma.%.findUnique  db info - reads
prisma.%.findFirst  db info - reads
{connection,entityManager,repository}.{delete,insert,recover,remove,save,softRemove,update}  db warning - writes
{connection,entityManager,queryRunner,repository}.query  db critical - writes
queryBuilder.{delete,insert,update}  db warning - writes
{entityManager,repository}.{find,findBy,findOne,findOneBy}  db info - reads
sequelize.query  db critical - writes
%.{bulkCreate,create,destroy,update,upsert}  db warning - writes
%.{count,findAll,findByPk,findOne,findOrCreate}  db info - reads
knex.raw  db critical - writes
knex{.%}?.{del,delete,insert,truncate,update}  db warning - writes
knex{.%}?.{count,first,pluck,select}  db info - reads
db.{delete,insert,update}  db warning - writes
db.execute  db critical - writes
db.{query,select}  db info - reads
{client,connection,db,mysql,pg,pool,postgres,sqlite}.{exec,execute,query,run}  db warning - writes
{client,connection,db,pool}.{begin,commit,rollback}  db warning - writes
cursor.{execute,executemany,executescript}  db critical - writes
better-sqlite3.Database.{exec,prepare,run}  db warning - writes
better-sqlite3.{exec,prepare,run}  db warning - writes
{ioredis,redis,redisClient}.{flushall,flushdb}  db critical - writes
{ioredis,redis,redisClient}.{append,decr,del,expire,hdel,hset,incr,lpush,psetex,rpush,sadd,set,setex,zadd}  db warning - writes
{ioredis,redis,redisClient}.{exists,get,hget,hgetall,keys,lrange,smembers,ttl,type,zrange}  db info - reads
{collection,db}.{bulkWrite,deleteMany,deleteOne,drop,insertMany,insertOne,replaceOne,updateMany,updateOne}  db warning - writes
{collection,db}.{aggregate,countDocuments,distinct,find,findOne}  db info - reads
{mailer,nodemailer,nodemailer.Transporter,transporter}.{send,sendMail}  api warning email writes
sgMail.{send,sendMultiple}  api warning email writes
mailgun.{messages\(\).send,messages.create}  api warning email writes
ses.{sendEmail,sendRawEmail,sendTemplatedEmail}  api warning email writes
s3Client.send  api warning aws-s3 writes
lambdaClient.send  api warning aws-lambda writes
snsClient.send  api warning aws-sns writes
sqsClient.send  api warning aws-sqs writes
dynamoDBClient.send  api warning aws-dynamodb writes
@aws-sdk/.*.send  api warning aws writes
page.evaluate  code critical - writes
page.evaluateHandle  code critical - writes
page.addScriptTag  code critical - writes
page.goto  api warning http writes
page.fill  api warning - writes
page.type  api warning - writes
page.click  api warning - writes
page.screenshot  file warning file writes
page.content  api info - reads
page.{setContent,setExtraHTTPHeaders}  api warning - writes
page.evaluateOnNewDocument  code critical - writes
{bull,bullmq,queue}.{add,addBulk,process}  api warning - writes
channel.{assertExchange,assertQueue,publish,sendToQueue}  api warning - writes
fs.{readFile,readFileSync}  file info file reads
fs.createReadStream  file info file reads
fs.{readdir,readdirSync}  file info directory reads
fs.{lstat,lstatSync,stat,statSync}  file info file reads
fs.{access,accessSync,exists,existsSync}  file info file reads
fs/promises.{access,lstat,readFile,readdir,stat}  file info file reads
fse?.{pathExists,pathExistsSync,readFile,readFileSync,readdir,readdirSync,stat,statSync}  file info file reads
glob{.sync}?  file info file reads
""")

SCRIPT_FALLBACK = parse(r"""
{exec,execFile,execFileSync,execSync,fork,spawn,spawnSync}  shell critical - writes
{Function,eval}  code critical - writes
{compileFunction,runInContext,runInNewContext,runInThisContext}  code critical - writes
{rm,rmSync,rmdir,rmdirSync,unlink,unlinkSync}  file critical - writes
{appendFile,appendFileSync,writeFile,writeFileSync}  file warning - writes
{readFile,readFileSync,readdir,readdirSync}  file info - reads
{executeRaw,executeRawUnsafe,queryRaw,queryRawUnsafe}  db critical - writes
{flushall,flushdb}  db critical - writes
{axios,fetch,got,request}  api warning - reads
{delete,patch,post,put}  api warning - writes
""")
